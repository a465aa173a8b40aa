"""Exact top-k inner-product search by distributed histogram selection.

Every query is scored against every vector, in blocks. Each round sums, per query, a histogram of the scores over the range in
which the k-th score still lies, and narrows that range to one bin; with a bin of width one the k-th score is known. A last
pass keeps the scores that reach it and breaks ties by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlink.llm.shared import materialise

BINS = 1024
#: Rows of a block: a task holds one block of queries, one of candidates and their scores.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Not null, not empty, no null and no non-finite component."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of lists as one matrix; shorter rows count as ended by zeros."""
    flat, offsets = np.asarray(column.flatten()), np.asarray(column.offsets) - column.offsets[0].as_py()
    size = np.diff(offsets)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(offsets[:-1], size)] = flat
    return out


def _scores(queries: pa.Table, candidates: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query row: its number, the candidates' ids and scores, without rows that have the query's id."""
    q, c = (t.column("v").combine_chunks() for t in (queries, candidates))
    width = max(max(x.value_lengths().to_numpy(zero_copy_only=False).max() for x in (q, c)), 1)
    a, b = matrix(q, width), matrix(c, width)
    ids, own = candidates.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    exact = np.float64 if top < 2**53 else np.int64  # both are exact there; floats are faster
    right = b.astype(exact).T.copy()
    for at in range(0, len(a), 64):
        block = (a[at : at + 64].astype(exact) @ right).astype(np.int64)
        for i, scores in enumerate(block, at):
            if (same := ids == own[i]).any():
                yield i, ids[~same], scores[~same]
            else:
                yield i, ids, scores


def _paired(queries: DataFrame, candidates: DataFrame, n_query_blocks: int, n_lanes: int, function, schema: str) -> DataFrame:
    """function(queries, candidates) on every pair of a block of queries and a block of candidates."""
    left = queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(n_lanes - 1))))
    right = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    return left.groupBy("lane", "block").cogroup(right.groupBy("lane", "block")).applyInArrow(function, schema)


def top_k(vectors: DataFrame, k: int, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest scores, all of them if there are fewer.

    Rows with a null id or an unusable vector take no part; a vector shorter than another counts as ended by zeros. A repeated
    row is a candidate as often as it is there, a repeated query is answered once. Rows with the query's id are no candidates of it.
    Vectors so long that a score might not fit in a long are an error.
    """
    rows = vectors.where(F.col(id_column).isNotNull() & usable(F.col(vector_column)))
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), whole_numbers(F.col(vector_column), scale).alias("v"), is_query.alias("is_query"))
    rows = materialise(rows.withColumn("u", F.xxhash64("vec_id", "v")))
    size = rows.agg(F.count("*"), F.count_if("is_query"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not size[0] or not size[1]:
        return vectors.sparkSession.createDataFrame([], schema)
    n_blocks, n_lanes = -(-size[1] // QUERY_BLOCK), max(-(-size[0] // CANDIDATE_BLOCK), min(32, -(-size[0] // 512)))
    bound = int(size[2] * (1 + 1e-9)) + 1  # by Cauchy and Schwarz no score is further from zero
    if bound >= 1 << 62:
        raise ValueError(f"scores up to {bound} don't fit in a long")
    candidates = rows.select("vec_id", "v", F.pmod(F.xxhash64("u", F.lit(1)), F.lit(n_lanes)).cast("int").alias("lane"))
    queries = rows.where("is_query").dropDuplicates(["u"]).select("u", "vec_id", "v", F.pmod("u", F.lit(n_blocks)).cast("int").alias("block"))

    span = 2 * bound + 1
    width = -(-span // BINS)
    queries = queries.withColumn("low", F.lit(-bound).cast("long")).withColumn("above", F.lit(0).cast("long"))
    while True:
        found = _paired(queries, candidates, n_blocks, n_lanes, _counter(k, width, span), "u long, bin int, n long")
        found = found.groupBy("u", "bin").agg(F.sum("n").alias("n"))
        down = F.sum("n").over(Window.partitionBy("u").orderBy(F.desc("bin")))
        # the bin in which the k-th score lies: the first, from above, up to which there are k scores
        found = found.withColumn("down", down)
        kth = queries.select("u", "above").join(found, "u").where(F.col("above") + F.col("down") >= k).groupBy("u").agg(F.max_by(F.struct("bin", (F.col("above") + F.col("down") - F.col("n")).alias("over")), "bin").alias("b"))
        queries = queries.join(kth, "u", "left").withColumn("low", F.when(F.col("b").isNotNull(), F.col("low") + F.col("b.bin").cast("long") * F.lit(width).cast("long"))).withColumn("above", F.coalesce("b.over", "above")).drop("b")
        queries = materialise(queries)  # a null low: fewer than k scores, all are kept
        if width == 1:
            break
        span, width = width, -(-width // BINS)
    best = _paired(queries, candidates, n_blocks, n_lanes, _selector(k), "u long, query_id long, vec_id long, score long")
    order = Window.partitionBy("u").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _counter(k: int, width: int, span: int):
    """Counts scores by bin of the query's range of span whole numbers; only bins that reach the block's own k-th score, as lower ones can't hold the k-th of all."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if queries.num_rows and candidates.num_rows:
            u, low = queries.column("u").to_numpy(), queries.column("low").to_pandas().to_numpy(float, na_value=np.nan)
            exact = queries.column("low").to_pylist()
            for i, _, scores in _scores(queries, candidates):
                if np.isnan(low[i]) or not len(scores):
                    continue
                scores = scores - exact[i]
                bins = scores[(scores >= 0) & (scores < span)] // width
                if len(bins):
                    if len(bins) > k:
                        bins = bins[bins >= np.partition(bins, len(bins) - k)[len(bins) - k]]
                    value, count = np.unique(bins, return_counts=True)
                    for cell, part in zip(out, (np.full(len(value), u[i]), value, count), strict=True):
                        cell.append(part)
        return pa.table({n: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)).cast(t) for n, x, t in zip(("u", "bin", "n"), out, (pa.int64(), pa.int32(), pa.int64()), strict=True)})

    return run


def _selector(k: int):
    """Scores that reach the query's k-th; of each block the k best by score and id are enough."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if queries.num_rows and candidates.num_rows:
            u, own, low = queries.column("u").to_pylist(), queries.column("vec_id").to_pylist(), queries.column("low").to_pylist()
            for i, ids, scores in _scores(queries, candidates):
                at = np.arange(len(scores)) if low[i] is None else np.flatnonzero(scores >= low[i])
                at = at[np.lexsort((ids[at], -scores[at]))[:k]]
                for cell, part in zip(out, ([u[i]] * len(at), [own[i]] * len(at), ids[at].tolist(), scores[at].tolist()), strict=True):
                    cell.extend(part)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("u", "query_id", "vec_id", "score"), out, strict=True)})

    return run


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, 5, F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
