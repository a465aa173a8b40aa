"""The linking stream against the same work in one batch, with documents in several files, restarts, deletions and repeated contents."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlink.operators import link
from claimlink.operators.facts import finalize_facts
from claimlink.sources import schemas, tables
from claimlink.sources.buckets import Buckets
from claimlink.streaming import ingest, linking

RAW = (
    "doc_id string, chunk_id string, ordinal int, page int, kind string, subject string, attribute string, value_text string, value_num double, unit string, scale string, period_label string, period_start string, "
    "period_end string, period_type string, basis string, scope string, quote string, confidence double, flags array<string>, embedding array<float>"
)


def raw_rows():
    rng, rows = np.random.default_rng(2), []
    for d, doc in enumerate("abcde"):
        for i in range(14):
            v = rng.normal(size=4) + (6 if i % 2 else -6) * np.eye(4)[i % 3]
            v = np.float32(v / np.linalg.norm(v)).tolist() if i % 7 else None
            value = 100.0 + (i // 2) * 10 + rng.choice([0.0, 0.3, 5.0])
            rows.append((doc, f"{doc}:1-2", i, 1 + i % 2, "numeric", f"Subject {i % 2}", f"Measure {i % 4}", str(value), float(value), "INR", "crore", f"FY{20 + i % 3}", "", "", "none", "", "", f"was {value}", 0.9, [], v))
    return rows


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """A stream that has run to its end. The tests below leave its results as they are, but for the last of them, which deletes."""
    tmp_path = tmp_path_factory.mktemp("stream")
    meta = spark.createDataFrame([(d, "Group", "") for d in "abcde"], "doc_id string, primary_subject string, fiscal_year_convention string").select("doc_id", F.struct("primary_subject", "fiscal_year_convention").alias("meta"))
    raw = spark.createDataFrame(raw_rows(), RAW)
    page = lambda doc, n: (doc, n, "\n".join(f"It was {r[8]} then." for r in raw_rows() if r[0] == doc and r[3] == n))
    files = [[page("b", 1)], [page("a", 1), page("c", 1)], [page("b", 2), page("b", 1)], [("a", 2, "sent wrongly"), page("d", 1), page("d", 2)], [page("a", 2), page("c", 2), page("e", 1), page("e", 2)]]
    for rows in files:
        spark.createDataFrame(rows, schemas.PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda **more: linking.stream_link(spark, ingest.page_stream(spark, f"{tmp_path}/in", schemas.PAGES), raw, meta, f"{tmp_path}/t", f"{tmp_path}/check", threshold=0.6, buckets=4, **more).awaitTermination()
    run()
    return raw, meta, run, str(tmp_path), linking.Layer(spark, f"{tmp_path}/t", 4)


def stored(spark, layer):
    pick = ("fact_a", "fact_b", "type", "reconciliation", "confidence", "reasoning", "method", "cross_document")
    return sorted(tuple(r) for r in layer.relations.read(linking.RELATIONS).select(*pick).collect())


def in_one_batch(spark, raw, meta, layer):
    made = finalize_facts(raw, meta).withColumn("fact_id", F.col("id")).join(layer.sequence.read(linking.SEQUENCE), "doc_id")
    ranked = link.rank_candidates(link.similarity_candidates(made, 0.6, mode="incremental"), link.key_candidates(made, "incremental"))
    none = spark.createDataFrame([], "fact_a string, fact_b string, type string, reconciliation string, confidence double, reasoning string, method string, cross_document boolean")
    relations, open_ = link.link_run(ranked, made.drop("embedding", "fact_id"), none)
    return ranked, sorted(tuple(r) for r in relations.collect()), open_


def test_stream_equals_one_batch(spark, source):
    raw, meta, run, folder, layer = source
    ranked, relations, open_ = in_one_batch(spark, raw, meta, layer)
    assert stored(spark, layer) == relations != []  # a list: no relation is there twice
    asked = spark.read.parquet(f"{folder}/t/candidates").where("NOT known").select("fact_id", "other_id").collect()
    assert {tuple(r) for r in asked} == {tuple(r) for r in ranked.select("fact_id", "other_id").collect()}
    batches = spark.read.parquet(f"{folder}/t/requests")
    assert {r.fact_id for r in batches.select("fact_id").collect()} == {r.fact_id for r in open_.select("fact_id").collect()} != set()
    facts = layer.facts.read(layer.facts.schema())
    assert facts.count() == raw.count() and facts.where("grounding <> 'exact'").isEmpty()
    assert sorted(r.doc_id for r in layer.sequence.read(linking.SEQUENCE).orderBy("doc_seq").collect()) == list("abcde")
    assert [r.doc_id for r in layer.sequence.read(linking.SEQUENCE).orderBy("doc_seq").collect()][0] == "b"

    totals = {r.doc_id: r for r in link.run_totals(spark.read.parquet(f"{folder}/t/runs")).collect()}
    of = {r.id: r.doc_id for r in facts.select("id", "doc_id").collect()}
    asker = {tuple(sorted(r)): of[r.fact_id] for r in ranked.select("fact_id", "other_id").collect()}
    assert {d: r.deterministic_relations for d, r in totals.items()} == {d: Counter(asker[r[:2]] for r in relations)[d] for d in "abcde"}
    assert all(r.new_facts == 14 for r in totals.values()) and totals["b"].candidates == 0

    before = stored(spark, layer)
    run()  # nothing new: nothing is done twice
    assert stored(spark, layer) == before


def test_a_batch_that_is_repeated_replaces_itself(spark, source):
    raw, meta, run, folder, layer = source
    before, versions = stored(spark, layer), layer.relations.versions()
    for name in ("4", ".4.crc"):  # as if the last batch had broken off before it was committed
        os.remove(f"{folder}/check/commits/{name}")
    run()
    assert stored(spark, layer) == before and layer.relations.versions() == versions
    assert layer.facts.read(layer.facts.schema()).count() == raw.count()


def test_what_a_batch_reads_does_not_grow(spark, source):
    *_, layer = source
    for table in (layer.pages, layer.facts, layer.sequence, layer.relations):
        assert all(len(v) <= 2 for v in table.versions().values())
        assert len(table.paths()) <= 4
    texts = {(r.doc_id, r.page_no): r.text for r in layer.pages.read(schemas.PAGES).collect()}
    assert len(texts) == 10 == layer.pages.read(schemas.PAGES).count() and "sent wrongly" not in texts.values()  # the later page counts


def test_deleting_from_a_layer(spark, source):
    *_, folder, layer = source
    of = {r.id: r.doc_id for r in layer.facts.read(layer.facts.schema()).select("id", "doc_id").collect()}
    before, paths = stored(spark, layer), set(layer.facts.paths())
    touched = layer.delete(spark.createDataFrame([("a",)], "doc_id string"))
    assert stored(spark, layer) == [r for r in before if "a" not in (of[r[0]], of[r[1]])] != before
    assert {r.doc_id for r in layer.facts.read(layer.facts.schema()).select("doc_id").distinct().collect()} == set("bcde")
    assert len(touched["facts"]) == 1 and len(paths - set(layer.facts.paths())) == 1  # other buckets keep their files
    assert layer.pages.read(schemas.PAGES).where("doc_id = 'a'").isEmpty()
    assert linking.Layer(spark, f"{folder}/nothing", 4).delete(spark.createDataFrame([("a",)], "doc_id string")) == {}


def test_buckets_that_are_emptied_or_written_again(spark, tmp_path):
    table = Buckets(spark, f"{tmp_path}/t", "k", 3)
    rows = spark.createDataFrame([(i, i % 2) for i in range(30)], "k int, v int")
    assert table.read(rows.schema).count() == 0 and table.schema() is None
    table.write(rows, 1, table.of(rows))
    table.write(rows.limit(0), 2, [1])
    assert table.read(rows.schema).count() == table.read(rows.schema, [0, 2]).count() < 30
    assert table.read(rows.schema, below=2).count() == 30
    table.write(rows.where(table.bucket() == 1), 3, [1])
    assert sorted(map(tuple, table.read(rows.schema).collect())) == sorted(map(tuple, rows.collect()))
    table.sweep(3)
    assert table.versions() == {0: [1], 1: [2, 3], 2: [1]}


def test_the_same_content_in_two_files_is_one_document(spark, tmp_path):
    kinds = "filename string, content string"
    for rows in ([("b.pdf", "x"), ("a.pdf", "x"), ("c.pdf", "y")], [("d.pdf", "x"), ("e.pdf", "z"), ("f.pdf", None)], [("c.pdf", "y"), ("g.pdf", "z")]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    source = lambda: spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda: linking.stream_register(spark, source(), f"{tmp_path}/t", f"{tmp_path}/check", 4, on_new=lambda new, n: seen.append((n, new.count()))).awaitTermination()
    run()
    run()
    layer = linking.Layer(spark, f"{tmp_path}/t", 4)
    got = layer.registered.read(linking.REGISTERED).where("doc_id IS NOT NULL").collect()
    assert len(got) == 3 and len({r.sha256 for r in got}) == 3 and {r.filename for r in got} <= {"a.pdf", "c.pdf", "d.pdf", "e.pdf", "g.pdf"}
    new = spark.read.parquet(f"{tmp_path}/t/documents").where("content IS NOT NULL")
    assert sorted(r.content for r in new.collect()) == ["x", "y", "z"] and len(seen) == 3


def test_deleting_rewrites_only_the_buckets_concerned(spark, tmp_path):
    facts = spark.createDataFrame([(f"{d}{i}", d, 1) for d in "abcdefgh" for i in range(3)], "id string, doc_id string, page_no int")
    tables.write_facts(facts, f"{tmp_path}/f", 4)
    tables.write_facts(facts.where("doc_id IN ('a', 'b')"), f"{tmp_path}/f", 4)
    files = lambda: {f"{d}/{x}" for d, _, xs in os.walk(f"{tmp_path}/f") for x in xs if x.endswith(".parquet")}
    before = files()
    touched = tables.delete_stored(spark, f"{tmp_path}/f", facts.where("doc_id = 'a'"), 4)
    kept = {f for f in before if f"doc_bucket={touched[0]}/" not in f}
    assert len(touched) == 1 and kept <= files() and not (before - kept) & files()
    left = spark.read.parquet(f"{tmp_path}/f")
    assert left.count() == 24 and left.where("doc_id = 'a'").isEmpty()
    assert tables.delete_stored(spark, f"{tmp_path}/f", facts, 4) == [0, 1, 2, 3] or not files()
    assert not files()
