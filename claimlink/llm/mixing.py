"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Sources share the mix by weight, none beyond so many times its own size. A document's expected number of copies follows from its
source's target; the whole part of it is certain. For the rest each document has a random number u and an inclusion probability p,
and the documents whose odds of u, divided by the odds of p, are the smallest make up the sample. Its size is fixed in words: the
ranking is followed until the source's words are there. Where that is comes from histograms of the ranking, refined until the
bin in question is small, so that no source, however large, is ever sorted in one place.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlink.llm.shared import discard, materialise

#: The ranking is a whole number of BITS bits; a round of refinement looks at STEP of them.
BITS, STEP = 50, 10
#: Documents of one source that a window orders at last.
MOST_IN_BIN = 4096
#: Times that what is left of a source's words is filled with further documents that fit.
PASSES = 3
#: A table by source is broadcast up to this many bytes; beyond that, documents meet it in a join salted SALTS times.
BROADCAST_BYTES, SALTS = 8 << 20, 32
#: Equal rows that one row stands for at most when they are written out again.
ROWS_AT_ONCE = 4096


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text, null: 0. Each word becomes one letter and the white space goes, so no list of words is built."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def _places(rows: DataFrame, column: str) -> DataFrame:
    """rows with place, from 0, in the order of a column, null last. Only partitions' sizes meet in one place."""
    order = F.asc_nulls_last(column)
    dealt = materialise(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    out = materialise(dealt.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + within).drop("part", "start"))
    discard(dealt)
    return out


def _beside(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """rows (key, id, ...) with the columns that by_source has for their key; rows of other keys go."""
    n, text = by_source.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    if 128 * n + text <= BROADCAST_BYTES:
        return rows.join(F.broadcast(by_source), "key")
    salted = by_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def water_level(units: DataFrame, total: float) -> float:
    """The level at which the units (weight, cap), each filled up to weight * level but never above its cap, hold the total.

    What is above a cap is shared out among the others again, until none is above. Weights and caps are whole numbers, so their sums
    don't depend on the order; only these sums reach the driver.
    """
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        n, held, weight = units.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == capped or not weight:
            return level
        capped, level = n, max(level, (total - held) / weight)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """sizes (key, source, source_size) with target: the words of the mix that each source is to have.

    Sources in order of their names by code point, null last, have the weights in turn; the mix has percent of all words.
    """
    placed = _places(sizes, "source")
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int"))
    units = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    total = units.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * percent / 100
    target = F.least(F.col("weight") * F.lit(water_level(units, total)), F.col("cap").cast("double"))
    return units.select("key", "source", "source_size", target.alias("target"))


def _cuts(units: DataFrame, needs: DataFrame) -> DataFrame:
    """For each source of needs (key, need): (key, asked, rank_cut, id_cut, part, need).

    Of its units that fit (size up to asked, rows free), those before the cut in the ranking are taken, and part rows of the one at
    the cut; need is what is then left. Without a cut (null) all are taken.
    """
    state = needs.select("key", F.col("need").alias("asked"), "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("n"))
    shift, words = BITS, F.col("size") * F.col("free")
    while True:
        shift -= STEP
        inside = _beside(units, state).where((F.col("free") > 0) & (F.col("size") > 0) & (F.col("size") <= F.col("asked")) & (F.shiftright("rank", shift + STEP) == F.col("prefix")))
        bins = inside.groupBy("key", F.shiftright("rank", shift).alias("bin")).agg(F.sum(words).alias("words"), F.count("*").alias("units"))
        bins = bins.withColumn("run", F.sum("words").over(Window.partitionBy("key").orderBy("bin")))
        open_ = state.where("prefix IS NOT NULL").select("key", F.col("need").alias("goal"))
        over = bins.join(open_, "key").groupBy("key").agg(F.min_by(F.struct("bin", (F.col("goal") - F.col("run") + F.col("words")).alias("need"), "units"), F.when(F.col("run") > F.col("goal"), F.col("bin"))).alias("c"), F.sum("words").alias("all"))
        kept, state = state, materialise(state.join(over, "key", "left").select(
            "key", "asked", F.when(F.col("all").isNull(), F.col("need")).when(F.col("c").isNull(), F.col("need") - F.col("all")).otherwise(F.col("c.need")).alias("need"), F.col("c.bin").alias("prefix"), F.coalesce("c.units", F.lit(0)).alias("n"),
        ))
        if shift < BITS - STEP:
            discard(kept)
        if shift <= 0 or (state.agg(F.max("n")).first()[0] or 0) <= MOST_IN_BIN:
            break
    order = Window.partitionBy("key").orderBy("rank", "id")
    last = _beside(units, state).where((F.col("free") > 0) & (F.col("size") > 0) & (F.col("size") <= F.col("asked")) & (F.shiftright("rank", shift) == F.col("prefix")))
    last = last.withColumn("before", F.sum(words).over(order) - words).where(F.col("before") + words > F.col("need"))
    part = F.greatest(F.floor((F.col("need") - F.col("before")) / F.col("size")), F.lit(0).cast("long"))
    cut = last.groupBy("key").agg(F.min_by(F.struct("rank", "id", part.alias("part"), (F.col("need") - F.col("before") - part * F.col("size")).alias("left")), F.struct("rank", "id")).alias("cut"))
    out = materialise(state.join(cut, "key", "left").select("key", "asked", F.col("cut.rank").alias("rank_cut"), F.col("cut.id").alias("id_cut"), F.col("cut.part").alias("part"), F.coalesce("cut.left", "need").alias("need")))
    discard(state)
    return out


def _take(units: DataFrame, cuts: DataFrame) -> DataFrame:
    """units with what the cuts take added to extra."""
    fits = (F.col("free") > 0) & (F.col("size") > 0) & (F.col("size") <= F.col("asked"))
    before = F.col("rank_cut").isNull() | (F.col("rank") < F.col("rank_cut")) | ((F.col("rank") == F.col("rank_cut")) & (F.col("id") < F.col("id_cut")))
    more = F.when(fits & before, F.col("free")).when(fits & (F.col("id") == F.col("id_cut")) & (F.col("rank") == F.col("rank_cut")), F.col("part")).otherwise(F.lit(0).cast("long"))
    return _beside(units, cuts).withColumn("more", more).select(*units.columns, "more").withColumns({"extra": F.col("extra") + F.col("more"), "free": F.col("free") - F.col("more")}).drop("more")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, importance: str | None = None, seed: int = 13) -> DataFrame:
    """(id, doc_id, source, size, source_size, target, copies): one row for each row of docs (doc_id, source, text), with the copies that the mix takes of it.

    A source's copies hold its target's words, or as near as whole documents come: what the ranking leaves is filled with documents
    that fit, and at last with the one that comes nearest. So a very long document is passed over where it would take too much.
    importance: a column of whole numbers that a document's expected copies are in proportion to; without it all documents of a
    source have the same. Nothing has more than most copies.

    Documents without words have size 0 and only certain copies, those of 0 words. Null texts are empty, a null source is a source
    of its own, null ids and extra columns are allowed, an empty table gives no rows. Equal rows (doc_id, source, text) are one unit
    of several rows: the first so many of them get a further copy. The same table, seed and parameters give the same rows.
    """
    plain = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"),
        (F.greatest(F.coalesce(F.col(importance).cast("long"), F.lit(0)), F.lit(0)) if importance else F.lit(1).cast("long")).alias("weight"),
    )
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "h")
    units = plain.withColumn("id", F.md5(name.cast("binary"))).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    units = materialise(units.groupBy("key", "source", "doc_id", "id", "size", "weight").agg(F.count("*").alias("rows")))
    sizes = units.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = source_targets(sizes, weights, percent, most)

    # expected copies: certain ones, and the probability of one more
    if importance:
        levels = materialise(_levels(units, targets, most))
        expected = F.least(F.col("weight") * F.col("level"), F.lit(float(most)))
    else:
        levels = targets.withColumn("level", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        expected = F.col("level")
    wide = _beside(units, levels.drop("source")).withColumn("expected", expected).withColumn("copies", F.floor("expected"))
    p = F.col("expected") - F.col("copies")
    u = (F.conv(F.substring("id", 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))
    z = F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))
    rank = F.coalesce(F.floor(z / (1 + z) * F.lit(float(1 << BITS))), F.lit((1 << BITS) - 1))
    wide = wide.withColumn("rank", F.least(rank, F.lit((1 << BITS) - 1))).withColumn("extra", F.lit(0).cast("long")).withColumn("free", F.when(p > 0, F.col("rows")).otherwise(0))
    before, units = units, materialise(wide.drop("level", "expected", "weight"))
    discard(before)
    certain = units.groupBy("key").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size") * F.col("rows")).alias("certain"))
    needs = materialise(certain.select("key", F.greatest(F.col("target") - F.col("certain"), F.lit(0.0)).alias("need")))

    for _ in range(PASSES):
        cuts = _cuts(units, needs)
        before, units = units, materialise(_take(units, cuts))
        discard(before)
        needs = cuts.select("key", "need")
    off = F.abs(F.col("size") - F.col("need"))
    near = _beside(units, needs).where((F.col("free") > 0) & (F.col("size") > 0) & (off < F.col("need")))
    near = near.groupBy("key").agg(F.min_by(F.col("id"), F.struct(off.alias("off"), "rank", "id")).alias("nearest"))
    last = F.when(F.col("id") == F.col("nearest"), F.col("extra") + 1).otherwise(F.col("extra"))
    units = _beside(units, materialise(needs.join(near, "key", "left").select("key", "nearest"))).withColumn("extra", last)
    return _row_by_row(units).select("id", "doc_id", "source", "size", "source_size", "target", (F.col("copies") + F.when(F.col("nth") <= F.col("extra"), 1).otherwise(0)).cast("int").alias("copies"))


def _levels(units: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """targets with level: the copies that a document of weight 1 of each source is expected to have (water_level, for all sources at once)."""
    words, levels = F.col("size") * F.col("rows"), targets.select("key", "target").withColumns({"level": F.lit(0.0), "capped": F.lit(-1).cast("long")})
    while True:
        full = F.lit(float(most)) <= F.col("weight") * F.col("level")
        sums = _beside(units.where("size > 0 AND weight > 0"), levels).groupBy("key").agg(F.count_if(full).alias("n"), F.sum(F.when(full, words).otherwise(0)).alias("held"), F.sum(F.when(~full, words * F.col("weight")).otherwise(0)).alias("open"))
        level = F.when((F.col("n") > F.col("capped")) & (F.col("open") > 0), F.greatest("level", (F.col("target") - most * F.col("held")) / F.col("open"))).otherwise(F.col("level"))
        before, levels = levels, materialise(levels.join(sums, "key", "left").select("key", "target", level.alias("level"), F.coalesce("n", "capped").alias("capped"), (F.col("n") > F.col("capped")).alias("moved")))
        if levels.where("moved").isEmpty():
            return targets.join(levels.select("key", "level"), "key")


def _row_by_row(units: DataFrame) -> DataFrame:
    """units with nth, one row for each of the equal rows that a unit stands for."""
    many = units.where(F.col("rows") > ROWS_AT_ONCE)
    chunks = many.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / ROWS_AT_ONCE)))).repartition("id", "chunk")
    dealt = chunks.withColumn("nth", F.explode(F.sequence(F.col("chunk") * ROWS_AT_ONCE + 1, F.least("rows", (F.col("chunk") + 1) * ROWS_AT_ONCE)))).drop("chunk")
    few = units.where(F.col("rows") <= ROWS_AT_ONCE).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return few.unionByName(dealt)


def take(docs: DataFrame, plan: DataFrame, seed: int = 13) -> DataFrame:
    """The mix itself: the rows of docs, as often as their plan (plan_mix with the same seed) says, with copy from 1."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    wanted = plan.groupBy("id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key")).agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    found = docs.withColumn("_id", F.md5(name.cast("binary"))).withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).dropDuplicates(["_id", "_key"])
    met = found.join(wanted.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "_copies"), ["_id", "_key"])
    return met.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("copy"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _pass_sql(i: int) -> str:
    fits = f"extra = 0 AND size > 0 AND p > 0 AND size <= need{i}"
    return f"""
r{i} AS (SELECT *, sum(CASE WHEN {fits} THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, id ROWS UNBOUNDED PRECEDING) AS run{i} FROM m{i}),
t{i} AS (SELECT * REPLACE (CASE WHEN {fits} AND run{i} <= need{i} THEN 1 ELSE extra END AS extra), {fits} AND run{i} <= need{i} AS now{i} FROM r{i}),
m{i + 1} AS (SELECT *, need{i} - sum(CASE WHEN now{i} THEN size ELSE 0 END) OVER (PARTITION BY source) AS need{i + 1} FROM t{i}),"""


OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('13:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS id FROM documents
), s AS (
  SELECT *, 2 * source_size AS cap, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source) x
), w AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT source, source_size, least(weight * (SELECT arg_min(level, cap / weight) FROM w WHERE level <= cap / weight), CAST(cap AS DOUBLE)) AS target FROM s
), e AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS expected FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
), f AS (
  SELECT *, CAST(floor(expected) AS BIGINT) AS copies, expected - floor(expected) AS p, (CAST('0x' || substr(id, 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM e
), g AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS z FROM f),
m1 AS (
  SELECT *, 0 AS extra, coalesce(CAST(floor(z / (1 + z) * 1125899906842624.0::DOUBLE) AS BIGINT), 0) AS rank, greatest(target - sum(copies * size) OVER (PARTITION BY source), 0.0) AS need1 FROM g
),{"".join(_pass_sql(i) for i in range(1, PASSES + 1))}
c AS (
  SELECT *, extra = 0 AND size > 0 AND p > 0 AND abs(size - need{PASSES + 1}) < need{PASSES + 1} AS may FROM m{PASSES + 1}
), n AS (SELECT *, row_number() OVER (PARTITION BY source, may ORDER BY abs(size - need{PASSES + 1}), rank, id) AS nth FROM c)
SELECT doc_id, size, source_size, target, CAST((copies + extra + CASE WHEN may AND nth = 1 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM n
"""
