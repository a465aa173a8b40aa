"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

Pairs of features interact through low-rank factors; a text is scored in time linear in its features, as the sum over pairs is
half the difference of the square of the sum and the sum of squares. The machine is fitted on a bounded sample of labelled
rows and scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlink.llm.quality_rules import text_stats
from claimlink.llm.shared import arrow_batches, steps, text_rows, utf8

BUCKETS, RANK = 1 << 16, 8
#: Bin edges of each structure statistic; a text has one feature of value 1 for each.
EDGES = {
    "n_words": (1, 5, 20, 50, 100, 200, 500, 1000, 3000),
    "mean_word": (1.5, 2.5, 3.5, 4.5, 5.5, 7, 9, 12),
    "symbol_share": (0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4),
    "upper_share": (0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.8),
    "pipe_share": (0.001, 0.01, 0.03, 0.1, 0.3),
    "repeat_share": (0.01, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8),
    "dup_line_share": (0.01, 0.05, 0.1, 0.2, 0.35, 0.5),
    "words_a_line": (3, 8, 15, 30, 60, 150),
    "distinct_share": (0.05, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9),
}
_BINS = 16
SIZE = BUCKETS + _BINS * len(EDGES)
#: Labelled rows that are used for fitting, at most.
SAMPLE = 6000


@dataclass(frozen=True)
class Machine:
    bias: float
    weight: np.ndarray  # float32 [SIZE]
    factor: np.ndarray  # float32 [SIZE, RANK]

    def logits(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Of n rows from (row, feature, value) sorted by row; every row has features."""
        first = np.searchsorted(row, np.arange(n))
        part = self.factor[feature] * value[:, None]
        total, squares = np.add.reduceat(part, first, axis=0), np.add.reduceat(part * part, first, axis=0)
        return self.bias + np.add.reduceat(self.weight[feature] * value, first) + 0.5 * (total * total - squares).sum(1)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of some texts, sorted by row. Words' values have length 1 together; empty texts have statistics only."""
    table, hashes, first = text_stats(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    key, count = np.unique(row.astype(np.int64) << 16 | (hashes >> np.uint64(48)).astype(np.int64), return_counts=True)
    word_row, word = key >> 16, key & (BUCKETS - 1)
    norm = np.sqrt(np.bincount(word_row, count.astype(float) ** 2, minlength=len(texts)))
    value = count / norm[word_row]
    distinct = np.bincount(word_row, minlength=len(texts))
    n, chars, symbols, dup, repeat, upper, lines, pipes, *_ = table.T
    m, rows = np.maximum(n, 1), np.maximum(lines, 1)
    stats = (n, chars / m, symbols / np.maximum(chars, 1), upper / m, pipes / m, repeat / m, dup / rows, n / rows, distinct / m)
    own = np.stack([BUCKETS + _BINS * k + np.digitize(stats[k], edges) for k, edges in enumerate(EDGES.values())])
    of_row = np.concatenate([word_row, np.tile(np.arange(len(texts)), len(EDGES))])
    order = np.argsort(of_row, kind="stable")
    return of_row[order], np.concatenate([word, own.ravel()])[order], np.concatenate([value, np.ones(own.size)])[order].astype(np.float32)


def fit(labels: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, a row at a time, in an order that the seed fixes. Without rows every score is 0.5."""
    rng = np.random.default_rng(seed)
    weight, factor, bias = np.zeros(SIZE), rng.normal(0, 0.01, (SIZE, RANK)), 0.0
    weight_sum, factor_sum, bias_sum = np.full(SIZE, 1e-3), np.full((SIZE, RANK), 1e-3), 1e-3
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            at, x = lists[i]
            part = factor[at] * x[:, None]
            total = part.sum(0)
            z = bias + weight[at] @ x + 0.5 * (total @ total - (part * part).sum())
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
            grad = error * x + decay * weight[at]
            weight_sum[at] += grad * grad
            weight[at] -= rate * grad / np.sqrt(weight_sum[at])
            grad = error * x[:, None] * (total - part) + decay * factor[at]
            factor_sum[at] += grad * grad
            factor[at] -= rate * grad / np.sqrt(factor_sum[at])
            bias_sum += error * error
            bias -= rate * error / bias_sum**0.5
    return Machine(bias, weight.astype(np.float32), factor.astype(np.float32))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """From the sample labelled rows outside the held-out fold with the smallest hashes of their ids. docs: doc_id, text; labels: doc_id, quality.
    Of several rows with one doc_id the largest text counts, of several labels the largest."""
    of = labels.where(F.col("quality").isin(0, 1) & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("y"))
    of = of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, hence broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            texts, at, x = utf8(batch.column(2)), [], []
            for a, b in steps(texts):
                row, feature, value = features(texts[a:b])
                ends = np.searchsorted(row, np.arange(1, b - a))
                at += np.split(feature, ends)
                x += np.split(value, ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "y", "at", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(of), "doc_id").groupBy("doc_id").agg(F.max(F.struct(F.col("y").cast("int").alias("y"), F.coalesce("text", F.lit("")).alias("text"))).alias("r"))
    rows = rows.select("doc_id", "r.y", "r.text").mapInArrow(run, f"doc_id {kind}, y int, at array<int>, x array<float>")
    found = sorted(rows.collect(), key=lambda r: r["doc_id"])  # at most sample, one for each doc_id
    return fit(np.array([r["y"] for r in found], float), [(np.array(r["at"], np.int64), np.array(r["x"])) for r in found])


def scores(texts: list[bytes], machine: Machine) -> np.ndarray:
    """The score of each text."""
    z = [machine.logits(*features(texts[a:b]), b - a) for a, b in steps(texts)]
    return 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *z]), -500, 500)))


def score(docs: DataFrame, machine: Machine, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, with score, one row for each row of docs; null texts are scored as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores(utf8(batch.column(0)), machine), pa.float64())], names=[*keep, "score"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"])
    return text_rows(docs).select(docs[text].alias("_text"), *keep).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns) that score threshold or more by a machine learnt from those with labels."""
    machine, at = learn(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            yield batch.filter(pa.array(scores(utf8(batch.column(at)), machine) >= threshold))

    own = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])  # names may clash
    return text_rows(docs).toDF(*own.names).mapInArrow(run, own).toDF(*docs.columns)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return score(docs, machine).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
