"""Documents that keep arriving, as one stream: registered, grounded, linked against what came before, with every result stored by key.

All state is in tables of buckets by document, written under the micro-batch's number: a batch that is repeated after a restart reads
what was there before it and replaces what it wrote. A micro-batch reads and writes only the buckets of its own documents; for the
search of candidates it also reads the stored facts' keys, vectors and values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlink.operators import link
from claimlink.operators.facts import finalize_facts
from claimlink.operators.ground import ground
from claimlink.sources.buckets import Buckets
from claimlink.sources.schemas import PAGES
from claimlink.sources.tables import register_documents
from claimlink.streaming.ingest import stream_batches

SEQUENCE = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("doc_seq", T.LongType())])
REGISTERED = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "sha256", "filename", "status")])
RELATIONS = T.StructType([*(T.StructField(c, T.StringType()) for c in ("doc_id", "fact_a", "fact_b", "type", "reconciliation", "reasoning", "method")), T.StructField("confidence", T.DoubleType()), T.StructField("cross_document", T.BooleanType())])


#: Versions from one micro-batch's to the next one's; deletions take those in between.
BETWEEN = 1024


class Layer:
    """The stored tables of a stream, in one folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.pages, self.sequence, self.facts, self.relations, self.registered = (Buckets(spark, f"{self.folder}/{name}", "doc_id", buckets) for name in ("pages", "sequence", "facts", "relations", "registered"))

    def batch(self, name: str, batch_id: int) -> str:
        return f"{self.folder}/{name}/batch={batch_id}"

    def written(self, rows: DataFrame, name: str, batch_id: int) -> DataFrame:
        """rows, written under the batch's number and read again."""
        rows.write.mode("overwrite").parquet(self.batch(name, batch_id))
        return self.spark.read.schema(rows.schema).parquet(self.batch(name, batch_id))

    def tables(self) -> list[Buckets]:
        return [self.pages, self.sequence, self.facts, self.relations, self.registered]

    def sweep(self, version: int) -> None:
        for table in self.tables():
            table.sweep(version)

    def delete(self, documents: DataFrame) -> dict[str, list[int]]:
        """Deletes documents (doc_id), their pages and facts, and all relations of these facts; the buckets of each table that were
        rewritten, which are those that held something of them."""
        version = 1 + max((v for t in self.tables() for vs in t.versions().values() for v in vs), default=0)
        gone, out = documents.select("doc_id").distinct(), {}
        if facts := self.facts.schema():
            lost = self.facts.read(facts, self.facts.of(gone)).join(gone, "doc_id", "left_semi").select("id")
            relations = self.relations.read(RELATIONS)
            hit = relations.select("doc_id", F.explode(F.array("fact_a", "fact_b")).alias("id")).join(lost, "id", "left_semi").select("doc_id")
            if own := self.relations.of(hit.unionByName(gone)):
                left = self.relations.read(RELATIONS, own)
                for end in ("fact_a", "fact_b"):
                    left = left.join(lost.select(F.col("id").alias(end)), end, "left_anti")
                self.relations.write(left.select(*RELATIONS.fieldNames()), version, own)
                out["relations"] = own
        for name, table in (("pages", self.pages), ("sequence", self.sequence), ("facts", self.facts), ("registered", self.registered)):
            if (schema := table.schema()) and (own := table.of(gone)):
                table.write(table.read(schema, own).join(gone, "doc_id", "left_anti").select(*schema.fieldNames()), version, own)
                out[name] = own
        return out


def store_pages(layer: Layer, batch: DataFrame, batch_id: int, buckets: list[int]) -> DataFrame:
    """All pages of the batch's buckets. Where a page has come twice the later batch counts; within a batch the greatest text."""
    rows = batch.select(*PAGES.fieldNames()).withColumn("later", F.lit(1)).unionByName(layer.pages.read(PAGES, buckets, BETWEEN * batch_id).withColumn("later", F.lit(0)))
    layer.pages.write(rows.groupBy("doc_id", "page_no").agg(F.max(F.struct("later", "text")).alias("x")).select("doc_id", "page_no", F.col("x.text").alias("text")), BETWEEN * batch_id, buckets)
    return layer.pages.read(PAGES, buckets, BETWEEN * batch_id + 1)


def store_sequence(layer: Layer, documents: DataFrame, batch_id: int, buckets: list[int]) -> DataFrame:
    """(doc_id, doc_seq) of the batch's buckets: documents in order of arrival, those of one batch in order of their ids."""
    stored = layer.sequence.read(SEQUENCE, buckets, BETWEEN * batch_id)
    new = link.document_sequence(documents.join(stored, "doc_id", "left_anti").withColumn("created_at", F.lit(batch_id)))
    new = new.select("doc_id", (F.lit(batch_id).cast("long") * (1 << 32) + F.col("doc_seq")).alias("doc_seq"))
    layer.sequence.write(stored.unionByName(new), BETWEEN * batch_id, buckets)
    return layer.sequence.read(SEQUENCE, buckets, BETWEEN * batch_id + 1)


def store_facts(layer: Layer, documents: DataFrame, raw: DataFrame, meta: DataFrame, pages: DataFrame, sequence: DataFrame, batch_id: int, buckets: list[int], tiers: str) -> DataFrame:
    """All facts stored so far, those of the batch's documents finalised and grounded again on all their pages."""
    made = finalize_facts(raw.join(documents, "doc_id", "left_semi"), meta).withColumn("fact_id", F.col("id"))
    made = made.withColumns({c: F.col("page") for c in ("page_start", "page_end") if c not in made.columns})
    if "embedding" not in made.columns:
        made = made.withColumn("embedding", F.lit(None).cast("array<float>"))
    made = ground(made, pages.join(documents, "doc_id", "left_semi"), tiers).withColumn("page_no", F.col("page")).join(sequence, "doc_id")
    others = layer.facts.read(made.schema, buckets, BETWEEN * batch_id).join(documents, "doc_id", "left_anti")
    layer.facts.write(made.unionByName(others), BETWEEN * batch_id, buckets)
    return layer.facts.read(made.schema, below=BETWEEN * batch_id + 1)


def link_arriving(known: DataFrame, asking: DataFrame, relations: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """The ranked candidates (J2, J3, U2) of asking facts among those of earlier documents, with known: whether the pair has a relation
    already, structs a and b, and settled: whether arithmetic decides it."""
    alike = link.similarity_candidates(known, threshold, mode="incremental", asking=asking)
    ranked = link.rank_candidates(alike, link.key_candidates(known, "incremental", asking=asking))
    pair = {"fact_a": F.least("fact_id", "other_id"), "fact_b": F.greatest("fact_id", "other_id")}
    ranked = ranked.withColumns(pair).join(relations.select("fact_a", "fact_b", F.lit(True).alias("known")), ["fact_a", "fact_b"], "left").drop("fact_a", "fact_b")
    return link.judge_numeric(ranked.withColumn("known", F.coalesce("known", F.lit(False))), known.drop("embedding", "fact_id"), tolerance)


def stream_link(
    spark: SparkSession, pages: DataFrame, raw: DataFrame, documents: DataFrame, folder: str, checkpoint: str, tiers: str = "all",
    threshold: float = link.SIMILARITY, tolerance: float = link.TOLERANCE, buckets: int = 64,
):
    """A stream of pages (doc_id, page_no, text) as a stored layer (Layer): pages, facts and relations, the requests for the judge
    (requests/batch=N: doc_id, batch, fact_id, size) and the log of runs (runs/batch=N: doc_id, run, measure, n).

    raw: facts as extracted, which are taken up when a page of their document arrives; an embedding column is used where there is one.
    A fact asks for candidates among the facts of documents that arrived before its own, in this batch or an earlier one. Pairs that
    have a relation aren't judged again, so a document that comes in several files gets each relation once. The relations are those
    that link_run gives on all facts at once, with documents in the order of their arrival.
    """
    layer = Layer(spark, folder, buckets)

    def process(batch: DataFrame, batch_id: int) -> None:
        arrived = layer.written(batch.select("doc_id").distinct(), "arrived", batch_id)
        own = layer.pages.of(arrived)
        text = store_pages(layer, batch, batch_id, own)
        sequence = store_sequence(layer, arrived, batch_id, own)
        known = store_facts(layer, arrived, raw, documents, text, sequence, batch_id, own, tiers)
        asking = known.join(arrived, "doc_id", "left_semi")
        stored = layer.relations.read(RELATIONS, own, BETWEEN * batch_id)
        found = layer.written(link_arriving(known, asking, stored, threshold, tolerance), "candidates", batch_id)
        fresh = found.where("NOT known")
        settled = link.deterministic_relations(fresh).select(*stored.columns)
        none = stored.limit(0).withColumns({"batch_id": F.lit(""), "position": F.lit(0)})
        layer.relations.write(link.upsert_relations(stored, settled, none), BETWEEN * batch_id, own)
        link.judge_batches(fresh).write.mode("overwrite").parquet(layer.batch("requests", batch_id))
        link.run_events(asking, found, stored, F.lit(batch_id)).write.mode("overwrite").parquet(layer.batch("runs", batch_id))
        layer.sweep(BETWEEN * batch_id)

    return stream_batches(pages, checkpoint, process)


def stream_register(spark: SparkSession, source: DataFrame, folder: str, checkpoint: str, buckets: int = 64, on_new: Callable[[DataFrame, int], None] | None = None):
    """A stream of (filename, content) as documents: of each content, in whatever files it comes, one document is registered.

    What is known is a table of ids without contents, of which a batch reads the buckets of its own ids only. documents/batch=N holds
    the new documents with their contents; on_new(documents, N) may go on from there."""
    layer = Layer(spark, folder, buckets)

    def process(batch: DataFrame, batch_id: int) -> None:
        ids = layer.written(batch.select(F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 12).alias("doc_id")).distinct(), "arrived", batch_id)
        own = layer.registered.of(ids)
        stored = layer.registered.read(REGISTERED, own, BETWEEN * batch_id)
        new = layer.written(register_documents(batch, stored), "documents", batch_id)
        layer.registered.write(stored.unionByName(new.select("doc_id", "sha256", "filename", F.lit("queued").alias("status"))).dropDuplicates(["doc_id"]), BETWEEN * batch_id, own)
        layer.registered.sweep(BETWEEN * batch_id)
        if on_new:
            on_new(new, batch_id)

    return stream_batches(source, checkpoint, process)
