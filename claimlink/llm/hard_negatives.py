"""Hard-negative mining: for each anchor and positive, the best rows of other labels within a band of scores below the positive's.

Anchors meet all rows in pairs of blocks. A first pass keeps each block's best rows of the anchor's label, which give its positives.
In a second one, every block sorts an anchor's whole-number scores by score and id, looks up each positive's upper limit in that
order by binary search, and reads on from there down to the lower limit. What blocks have found is merged by score and id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlink.llm.shared import discard, materialise
from claimlink.llm.topk import matrix, usable, whole_numbers

#: Rows of a block, at most; fewer if vectors are so long that a block would have more than BLOCK_BYTES.
ANCHOR_BLOCK, ROW_BLOCK, BLOCK_BYTES = 4096, 32_768, 1 << 25
#: Blocks that small tables are dealt to, for the sake of parallel work.
SPREAD = 32

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _scored(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor: its number, the ids and scores of the rows but those with its id, and whether they have its label."""
    a, b = (t.column("v").combine_chunks() for t in (anchors, rows))
    width = max(max(x.value_lengths().to_numpy(zero_copy_only=False).max() for x in (a, b)), 1)
    left, right = matrix(a, width), matrix(b, width)
    own, own_label, ids, labels = (t.column(c).to_numpy() for t in (anchors, rows) for c in ("id", "label"))
    top = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * width
    exact = np.float64 if top < 2**53 else np.int64  # both are exact there; floats are faster
    left, right = left.astype(exact), right.astype(exact).T.copy()
    for at in range(0, len(left), 32):
        for i, scores in enumerate((left[at : at + 32] @ right).astype(np.int64), at):
            other = ids != own[i]
            yield i, ids[other], scores[other], labels[other] == own_label[i]


def _first_of_label(n: int):
    """The n best rows of each anchor's label among a block's."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if anchors.num_rows and rows.num_rows:
            u = anchors.column("u").to_numpy()
            for i, ids, scores, same in _scored(anchors, rows):
                ids, scores = ids[same], scores[same]
                best = np.lexsort((ids, -scores))[:n]
                for cell, part in zip(out, (np.full(len(best), u[i]), ids[best], scores[best]), strict=True):
                    cell.append(part)
        return _table(out, ("u", "positive_id", "positive_score"))

    return run


def _below_positives(n: int, lower: int, upper: int):
    """The n best rows of other labels within each positive's band among a block's."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if anchors.num_rows and rows.num_rows:
            u, positives = anchors.column("u").to_numpy(), anchors.column("positives").to_pylist()
            for i, ids, scores, same in _scored(anchors, rows):
                ids, scores = ids[~same], scores[~same]
                order = np.lexsort((ids, -scores))
                falling = -scores[order]
                for p in positives[i]:
                    most, least = upper * p["positive_score"] // 100, -(-lower * p["positive_score"] // 100)
                    first = int(np.searchsorted(falling, -most))
                    some = order[first : first + n]
                    some = some[scores[some] >= least]
                    for cell, part in zip(out, (np.full(len(some), u[i]), np.full(len(some), p["nth"]), ids[some], scores[some]), strict=True):
                        cell.append(part)
        return _table(out, ("u", "nth", "negative_id", "negative_score"))

    return run


def _table(cells: list[list[np.ndarray]], names: tuple[str, ...]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for n, c in zip(names, cells, strict=True)})


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, lower: int = 50, upper: int = 95,
    id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding", scale: int = 256,
) -> DataFrame:
    """RESULT: for each anchor, its n_positives best rows of the same label, and for each of those the n_negatives best rows of other
    labels whose score is between lower and upper percent of the positive's.

    Scores are inner products of floor(scale * x); higher ones come first, ties by the smaller id. Rows with a null id or label, or an
    unusable vector, take no part; a vector shorter than another counts as ended by zeros. Rows with the anchor's id are neither
    positives nor negatives of it. A repeated row counts as often as it is there, so it can be two positives, each with negatives of
    its own; a repeated anchor is answered once. Anchors without positives, and positives without negatives, have no rows.
    Vectors so long that a hundred scores might not fit in a long are an error.
    """
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & usable(F.col(vector_column)))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), whole_numbers(F.col(vector_column), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = materialise(rows.withColumn("deal", F.rand(7)))  # written once, so that a row keeps its block
    n, n_anchors, longest, norm = rows.agg(F.count("*"), F.count_if("is_anchor"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()
    if not n or not n_anchors:
        return vectors.sparkSession.createDataFrame([], RESULT)
    if norm * 100 >= 1 << 62:  # by Cauchy and Schwarz no score is further from zero
        raise ValueError(f"scores up to {norm:g} times 100 don't fit in a long")
    fit = max(1, BLOCK_BYTES // (8 * longest))
    n_lanes = max(-(-n // min(ROW_BLOCK, fit)), min(SPREAD, -(-n // 512)))
    n_blocks = -(-n_anchors // min(ANCHOR_BLOCK, fit))

    right = rows.select("id", "label", "v", F.floor(F.col("deal") * n_lanes).cast("int").alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    anchors = rows.where("is_anchor").withColumn("u", F.xxhash64("id", "label", "v")).dropDuplicates(["u"]).select("u", "id", "label", "v", F.pmod("u", F.lit(n_blocks)).cast("int").alias("block"))

    def in_blocks(left: DataFrame, function, schema: str) -> DataFrame:
        left = left.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(n_lanes - 1))))
        return left.groupBy("lane", "block").cogroup(right.groupBy("lane", "block")).applyInArrow(function, schema)

    found = in_blocks(anchors, _first_of_label(n_positives), "u long, positive_id long, positive_score long")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("positive_score"), "positive_id"))).where(F.col("nth") <= n_positives)
    positives = found.groupBy("u").agg(F.collect_list(F.struct("nth", "positive_id", "positive_score")).alias("positives"))
    asking = materialise(anchors.join(positives, "u"))

    below = in_blocks(asking, _below_positives(n_negatives, lower, upper), "u long, nth long, negative_id long, negative_score long")
    below = below.withColumn("rank", F.row_number().over(Window.partitionBy("u", "nth").orderBy(F.desc("negative_score"), "negative_id"))).where(F.col("rank") <= n_negatives)
    of = asking.select("u", F.col("id").alias("anchor_id"), F.explode("positives").alias("p")).select("u", "anchor_id", "p.*")
    out = materialise(below.join(of.withColumn("nth", F.col("nth").cast("long")), ["u", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    discard(rows, asking)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", label.alias("label"))
    return mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) x WHERE nth <= 5
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, nth ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
