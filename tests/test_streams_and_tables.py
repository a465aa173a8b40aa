"""Arriving documents, stored tables and reruns."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlink.operators import ground, link
from claimlink.sources import schemas, tables
from claimlink.streaming import ingest

TEXTS = {"a": "Revenue rose to 8,142 in the year, costs fell.", "b": "The profit of the group was 127 in total."}


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    for doc, text in TEXTS.items():
        spark.createDataFrame([(doc, 1, text)], schemas.PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    facts = spark.createDataFrame([(f"{d}1", d, 1, None, None, "statement", None, t[:20].upper(), 1.0, []) for d, t in TEXTS.items()], "fact_id string, doc_id string, page int, page_start int, page_end int, kind string, value_num double, quote string, confidence double, flags array<string>")
    stream = lambda: ingest.stream_ground(spark, ingest.page_stream(spark, f"{tmp_path}/in", schemas.PAGES), facts, f"{tmp_path}/out", f"{tmp_path}/check", "exact").awaitTermination()
    stream()
    stream()  # nothing new: nothing is done twice
    got = spark.read.parquet(f"{tmp_path}/out").select("fact_id", "grounding", "quote_start", "quote_end")
    batch = ground.ground(facts, tables.read_pages(spark, f"{tmp_path}/in"), "exact").select(*got.columns)
    assert sorted(got.collect()) == sorted(batch.collect()) and got.count() == 2


def test_same_content_is_one_document(spark):
    new = spark.createDataFrame([("b.pdf", "x"), ("a.pdf", "x"), ("c.pdf", "y"), ("d.pdf", "z")], "filename string, content string")
    ids = {r.filename: r.doc_id for r in tables.register_documents(new, spark.createDataFrame([], "doc_id string, status string")).collect()}
    assert set(ids) == {"a.pdf", "c.pdf", "d.pdf"}
    stored = spark.createDataFrame([(ids["a.pdf"], "done"), (ids["c.pdf"], "failed")], "doc_id string, status string")
    assert {r.filename for r in ingest.fresh_documents(new, stored).collect()} == {"c.pdf", "d.pdf"}
    assert tables.register_documents(new, stored, replace=True).count() == 3


def test_incremental_links_go_back_only(spark):
    columns = "fact_id string, id string, doc_id string, doc_seq int, kind string, attribute_key string, embedding array<float>, unit string, scope string, basis string, period_start string, period_end string, value_norm double"
    row = lambda i, d, s, v: (i, i, d, s, "numeric", "k", [1.0, 0.0], "INR", "", "", "2023-04-01", "2024-03-31", v)
    old = spark.createDataFrame([row("a", "x", 1, 100.0)], columns)
    new = spark.createDataFrame([row("b", "y", 2, 100.5), row("c", "z", 3, 200.0), row("d", "z", 3, 100.4)], columns)
    assert {(r.fact_a, r.fact_b) for r in ingest.link_batch(new, old).collect()} == {("a", "b"), ("a", "d"), ("b", "d")}
    assert ingest.link_batch(new.limit(0), old).count() == 0


def test_upsert_is_idempotent(spark):
    current = spark.createDataFrame([("a", "b", "unrelated", "llm"), ("a", "c", "corroborates", "deterministic")], "fact_a string, fact_b string, type string, method string")
    settled = spark.createDataFrame([("a", "b", "corroborates", "deterministic"), ("b", "c", "corroborates", "deterministic")], current.schema)
    judged = spark.createDataFrame([("a", "b", "unrelated", "llm", "1", 1), ("a", "b", "contradicts", "llm", "1", 2), ("a", "c", "contradicts", "llm", "1", 3)], "fact_a string, fact_b string, type string, method string, batch_id string, position int")
    once = link.upsert_relations(current, settled, judged)
    expected = {("a", "b", "contradicts", "llm"), ("a", "c", "corroborates", "deterministic"), ("b", "c", "corroborates", "deterministic")}
    assert {tuple(r) for r in once.collect()} == expected
    assert sorted(map(tuple, link.upsert_relations(once, settled, judged).collect())) == sorted(expected)


def test_writing_facts_deleting_and_exporting(spark, tmp_path):
    facts = spark.createDataFrame([("1", "x", 1), ("2", "y", 1)], "id string, doc_id string, page_no int")
    tables.write_facts(facts, f"{tmp_path}/facts", 4)
    tables.write_facts(facts.where("id = '1'"), f"{tmp_path}/facts", 4)
    assert spark.read.parquet(f"{tmp_path}/facts").count() == 3
    layer = {"documents": facts.select("doc_id"), "pages": facts.select("doc_id", "page_no", F.lit("t").alias("text")), "facts": facts, "relations": spark.createDataFrame([("1", "2"), ("3", "4")], "fact_a string, fact_b string")}
    left = tables.delete_documents(layer, facts.where("id = '1'").select("doc_id"))
    assert [left[n].count() for n in ("documents", "pages", "facts", "relations")] == [1, 1, 1, 1]
    tables.export_json(left, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json/pages").first()["pages"]["1"] == "t"
    tables.append_calls(layer["relations"], f"{tmp_path}/calls")
    assert spark.read.parquet(f"{tmp_path}/calls").count() == 2


def test_a_document_in_several_files_gives_each_fact_once(spark, tmp_path):
    rows = [[("a", 1, "Revenue rose to 8,142 in the year, costs fell.")], [("a", 2, "The outlook for the group is good."), ("b", 1, "The profit of the group was 127 in total.")], [("a", 1, "Revenue rose to 8,142 in the year, costs fell.")]]
    for part in rows:
        spark.createDataFrame(part, schemas.PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    facts = spark.createDataFrame(
        [("a1", "a", 1, "REVENUE ROSE TO 8,142"), ("a2", "a", 2, "outlook for the group"), ("b1", "b", 1, "profit of the group")], "fact_id string, doc_id string, page int, quote string"
    ).selectExpr("*", "page AS page_start", "page AS page_end", "'statement' AS kind", "CAST(NULL AS DOUBLE) AS value_num", "1.0D AS confidence", "CAST(array() AS array<string>) AS flags")
    ingest.stream_ground(spark, ingest.page_stream(spark, f"{tmp_path}/in", schemas.PAGES), facts, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = ingest.latest(spark, f"{tmp_path}/out").select("fact_id", "grounding", "page")
    assert sorted(map(tuple, got.collect())) == [("a1", "exact", 1), ("a2", "exact", 2), ("b1", "exact", 1)]


def test_ingest_stream_equals_batch(spark, sf_dir, tmp_path):
    from claimlink.jobs import adapters
    from claimlink.operators.facts import finalize_facts

    raw, documents = adapters.raw_numbers(spark, sf_dir).where("scope IN ('Nation 1', 'Nation 2')"), adapters.publishers(spark, sf_dir)
    for doc in ("A1", "B1", "A2", "B2"):
        for page in (1, 2):
            spark.createDataFrame([(doc, page, f"Page {page} of {doc}")], schemas.PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: ingest.stream_ingest(spark, ingest.page_stream(spark, f"{tmp_path}/in", schemas.PAGES), raw, documents, f"{tmp_path}/t", f"{tmp_path}/check", "exact").awaitTermination()
    run()
    run()  # nothing new: nothing is done twice
    made = finalize_facts(raw, documents)
    assert sorted(r.id for r in ingest.latest(spark, f"{tmp_path}/t/facts").select("id").collect()) == sorted(r.id for r in made.select("id").collect())
    pairs = lambda df: {(r.fact_a, r.fact_b) for r in df.select("fact_a", "fact_b").collect()}
    assert pairs(spark.read.parquet(f"{tmp_path}/t/relations")) == pairs(link.numeric_matches(made)) != set()
