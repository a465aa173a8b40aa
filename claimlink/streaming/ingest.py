"""Documents that keep arriving: each micro-batch is registered, grounded and linked against what is stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlink.operators.facts import finalize_facts
from claimlink.operators.ground import ground
from claimlink.operators.link import agree, as_pairs, gap, key_candidates, matches_of_new
from claimlink.sources.tables import register_documents


def page_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = 1) -> DataFrame:
    """Files of pages as a stream, so many a micro-batch; None: all that are there when it starts."""
    source = spark.readStream.schema(schema)
    return (source.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else source).parquet(path)


def stream_batches(source: DataFrame, checkpoint: str, process: Callable[[DataFrame, int], None], available_now: bool = True):
    """Runs process(batch, id) on each micro-batch. The checkpoint takes up again after a restart; process must write by batch id."""
    writer = source.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def fresh_documents(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents of a micro-batch (filename, content) whose content isn't stored; copies within the batch are one. stream_register
    of claimlink.streaming.linking does so for each batch, with what is stored as a table of ids."""
    return register_documents(batch, stored)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of each document (doc_id) from the last micro-batch that wrote any: a document whose pages come in several files
    is written again with each of them, and what it had before no longer counts."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["doc_id", "batch"], "left_semi").drop("batch")


def _pages_so_far(batch: DataFrame, batch_id: int, path: str) -> DataFrame:
    """All pages that have come of the documents in this batch. A batch is stored under its id, so that a repeated one replaces itself.
    Where a page has come twice the later batch counts; within a batch the greatest text."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    stored = batch.sparkSession.read.parquet(path).where(F.col("batch") <= batch_id)
    stored = stored.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")
    return stored.groupBy("doc_id", "page_no").agg(F.max(F.struct("batch", "text")).alias("x")).select("doc_id", "page_no", F.col("x.text").alias("text"))


def stream_ground(spark: SparkSession, pages: DataFrame, facts: DataFrame, out: str, checkpoint: str, tiers: str = "all"):
    """Grounds the facts of each arriving document, again if more of its pages come; latest(spark, out) has each fact once.
    A batch is written under its id, so that a repeated one replaces itself. The pages are kept beside out."""

    def process(batch: DataFrame, batch_id: int) -> None:
        known = _pages_so_far(batch, batch_id, f"{out}-pages")
        own = facts.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")
        ground(own, known, tiers).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream_batches(pages, checkpoint, process)


def stream_ingest(spark: SparkSession, pages: DataFrame, raw: DataFrame, documents: DataFrame, folder: str, checkpoint: str, tiers: str = "all"):
    """Each micro-batch of pages is stored, the facts of its documents (raw, as extracted) are finalised, grounded and linked
    against all facts stored so far. folder/facts (read by latest) and folder/relations hold the results, a batch under its id.

    Earlier documents aren't worked on again: only new facts ask for partners. A document that comes late links to all stored ones.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        known = _pages_so_far(batch, batch_id, f"{folder}/pages")
        own = raw.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")
        made = finalize_facts(own, documents).withColumn("fact_id", F.col("id"))
        made = made.withColumns({c: F.col("page") for c in ("page_start", "page_end") if c not in made.columns})
        ground(made, known, tiers).write.mode("overwrite").parquet(f"{folder}/facts/batch={batch_id}")
        new = spark.read.parquet(f"{folder}/facts/batch={batch_id}")
        found = matches_of_new(new, latest(spark, f"{folder}/facts"))
        if batch_id:  # a document in several files gives each relation once
            before = spark.read.parquet(f"{folder}/relations").where(F.col("batch") < batch_id).select("fact_a", "fact_b")
            found = found.join(before, ["fact_a", "fact_b"], "left_anti")
        found.write.mode("overwrite").parquet(f"{folder}/relations/batch={batch_id}")

    return stream_batches(pages, checkpoint, process)


def link_batch(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(fact_a, fact_b, delta): pairs of a new fact and one of an earlier document, by key, whose values agree.

    facts: fact_id, id, doc_id, doc_seq, kind, attribute_key, embedding and the compared columns. Documents of one batch keep their order.
    """
    known = stored.unionByName(new)
    arrived = new.agg(F.min("doc_seq").alias("from")).first()["from"]
    pairs = as_pairs(key_candidates(known, "incremental", asking=new)) if arrived is not None else None
    if pairs is None:
        return new.select(F.col("id").alias("fact_a"), F.col("id").alias("fact_b"), F.lit(0.0).alias("delta")).limit(0)
    side = lambda p: known.select(F.col("id").alias(f"fact_{p}"), F.struct(*known.columns).alias(p))
    return pairs.join(side("a"), "fact_a").join(side("b"), "fact_b").where(agree("a", "b")).select("fact_a", "fact_b", gap("a", "b").alias("delta"))
