"""Reading, registering, admitting, writing and deleting the tables of the layer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlink.sources.schemas import FACT_COLUMNS, PAGES


def workspace(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; on a local master a temporary one where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="claimlink-")
    return f"{shared.rstrip('/')}/work-{uuid.uuid4().hex}"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages; their order is that of page_no, never that of rows."""
    return spark.read.schema(PAGES).parquet(path)


def register_documents(arriving: DataFrame, existing: DataFrame, replace: bool = False) -> DataFrame:
    """arriving (filename, content) as rows of doc_id, sha256, filename, content that are to be processed.

    The id comes from the content, so equal contents are one document: the first filename counts. Contents that are there already
    are left out unless they failed or are to be replaced. Copies are aggregated by the id where they lie, before any content is
    shuffled; after that each content moves once.
    """
    sha = F.sha2(F.col("content").cast("binary"), 256)
    new = arriving.withColumn("sha256", sha).withColumn("doc_id", F.substring("sha256", 1, 12))
    columns = [c for c in new.columns if c != "doc_id"]
    new = new.groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.struct("filename", "sha256")).alias("first")).select(*(F.col("doc_id") if c == "doc_id" else F.col(f"first.`{c}`").alias(c) for c in new.columns))
    return new if replace else new.join(existing.where("status <> 'failed'").select("doc_id"), "doc_id", "left_anti")


def admit(uploads: DataFrame, max_mb: float = 30, max_pages: int = 150, extension: str = ".pdf") -> DataFrame:
    """uploads (filename, size_bytes, page_count) with reject_reason, null for those that are admitted; the first reason counts."""
    reason = F.when(~F.endswith(F.lower("filename"), F.lit(extension)), "not a document of the right kind").when(F.col("size_bytes") > max_mb * 1024 * 1024, "too large").when(F.col("page_count") > max_pages, "too many pages")
    return uploads.withColumn("reject_reason", reason)


def current_status(events: DataFrame) -> DataFrame:
    """The last of the status events (doc_id, seq, status, error) of each document."""
    return events.groupBy("doc_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("error", "seq").alias("error"))


def write_facts(facts: DataFrame, path: str, buckets: int = 64) -> None:
    """Appends facts in a fixed order of columns, one folder for each hash bucket of documents."""
    rows = facts.select(*(c for c in FACT_COLUMNS if c in facts.columns), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("doc_bucket"))
    rows.repartition("doc_bucket").write.mode("append").partitionBy("doc_bucket").parquet(path)


def append_calls(calls: DataFrame, path: str) -> None:
    """Appends to the log of calls, failed ones included."""
    calls.write.mode("append").parquet(path)


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """documents, pages, facts and relations without the documents with these ids (doc_id); the log of calls is kept."""
    gone = ids.select("doc_id").distinct()
    lost = tables["facts"].join(gone, "doc_id", "left_semi").select("id")
    out = {n: tables[n].join(gone, "doc_id", "left_anti") for n in ("documents", "pages", "facts")}
    kept = tables["relations"]
    for side in ("fact_a", "fact_b"):
        kept = kept.join(lost.select(F.col("id").alias(side)), side, "left_anti")
    return tables | out | {"relations": kept.select(*tables["relations"].columns)}


def delete_stored(spark: SparkSession, path: str, ids: DataFrame, buckets: int = 64) -> list[int]:
    """Deletes the rows of documents (doc_id) from a table that write_facts wrote; the buckets that were rewritten. Files of other
    buckets aren't touched, nor read. A bucket of which nothing is left goes."""
    gone = ids.select("doc_id").distinct()
    of = sorted(r[0] for r in gone.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("b")).distinct().collect())
    rows = spark.read.parquet(path).where(F.col("doc_bucket").isin(of))
    left = rows.join(gone, "doc_id", "left_anti").select(*rows.columns)
    full = {r[0] for r in left.select("doc_bucket").distinct().collect()}
    left.hint("rebalance", "doc_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(path)
    for bucket in set(of) - full:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/doc_bucket={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return of


def page_maps(pages: DataFrame) -> DataFrame:
    """(doc_id, pages): a document's texts by page number."""
    return pages.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_no", "text")))).alias("pages"))


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each table, pages as one map for each document."""
    for name, rows in tables.items():
        (page_maps(rows) if name == "pages" else rows).write.mode("overwrite").json(f"{path}/{name}")
