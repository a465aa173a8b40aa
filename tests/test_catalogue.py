"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from claimlink.jobs import adapters, catalogue
from claimlink.operators import ground, link, passages

def value(v):
    return round(v, 6) if isinstance(v, float) else v


def rows_of(cells, columns, wanted):
    at = [columns.index(c) for c in wanted]
    return sorted((tuple(value(r[i]) for i in at) for r in cells), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows_of(got.select(*(f"`{c}`" for c in columns)).collect(), columns, columns) == rows_of(found.fetchall(), names, columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).limit(1).count() == 1


def test_ground_exact_in_all_languages(spark, sf_dir):
    fold = lambda x: re.sub(r"\s+", " ", x).lower()
    pages = {(r.doc_id, r.page_no): r.text for r in adapters.pages(spark, sf_dir).collect()}
    expected = {}
    for r in adapters.quotes(spark, sf_dir).select("fact_id", "doc_id", "page", "quote").collect():
        near = [(p, pages[r.doc_id, p]) for p in (r.page, r.page - 1, r.page + 1) if (r.doc_id, p) in pages]
        hits = [(p, "exact", 100.0 if r.quote in x else 99.0) for p, x in near if r.quote in x or fold(r.quote) in fold(x)]
        expected[r.fact_id] = hits[0] if hits else (r.page, "unverified", 0.0)
    got = {r[0]: tuple(r[1:]) for r in catalogue.queries()["ground_exact_all_languages"](spark, sf_dir).collect()}
    assert got == expected
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang").collect()
    exact = {i.split("-")[0] for i, x in got.items() if x[1] == "exact"}
    assert {r.lang for r in langs if str(r.doc_id) in exact} == {r.lang for r in langs} > {"en"}


def test_grounding_tiers_count_what_grounding_finds(spark, sf_dir):
    stored = adapters.quotes(spark, sf_dir)
    first = ground.ground(stored.withColumn("page_start", F.col("page")).withColumn("page_end", F.col("page") + 1), adapters.pages(spark, sf_dir))
    counts = {r.grounding: r.n for r in catalogue.queries()["grounding_tiers"](spark, sf_dir).collect()}
    assert counts == {r.grounding: r["count"] for r in first.groupBy("grounding").count().collect()}
    assert {"exact", "fuzzy"} <= set(counts) and sum(counts.values()) == stored.count()


def test_passages_of_any_length_are_found(spark, monkeypatch):
    monkeypatch.setattr(passages, "SHORT_AT_ONCE", 2)
    rng = random.Random(3)
    words = ["one", "two", "three", "four", "fi", "ve", "é", "😀", ""]
    texts = [None, "", *(" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60))]
    given = [(None), "", "one", "one two", "one two three", "ve", "n", " ", "  ", "😀 é", "one two three four", "ree four", "not there", "not there at all ever", texts[5], texts[9][3:20], texts[9][3:20]]
    items = spark.createDataFrame(list(enumerate(given)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("start", F.lit("x"))
    expected = sorted((i, d, t.index(p)) for i, p in enumerate(given) if p is not None for d, t in enumerate(texts) if t is not None and p in t)
    assert sorted(map(tuple, passages.locate_passages(items, docs).collect())) == expected
    assert passages.locate_passages(items.limit(0), docs).count() == 0 == passages.locate_passages(items, docs.limit(0)).count()


def test_facts_come_in_order(spark, duck, sf_dir):
    got = [tuple(r) for r in catalogue.queries()["facts_in_order"](spark, sf_dir).collect()]
    assert got == duck.execute(catalogue.oracle_sql()["facts_in_order"]).fetchall()


def test_candidates_are_searched_once_for_link_stats(spark, sf_dir, monkeypatch):
    calls, search = [], link.similarity_candidates
    monkeypatch.setattr(link, "similarity_candidates", lambda *a, **b: calls.append(1) or search(*a, **b))
    found = catalogue.queries()["link_stats"](spark, sf_dir)
    assert len(calls) == 1 and "FlatMapCoGroups" not in found._jdf.queryExecution().toString()


def test_arriving_parts_are_written_by_many_tasks(spark, tmp_path):
    rows, counts = spark.range(0, 900, 1, 6).withColumnRenamed("id", "doc_id"), []
    for _ in catalogue._arriving(rows, F.col("doc_id") % 3, str(tmp_path / "in"), "doc_id") or []:
        counts.append(len(list((tmp_path / "in").glob("part-*"))))
    assert counts == [6, 12, 18] and spark.read.parquet(str(tmp_path / "in")).count() == 900


def test_lines_are_split_once_and_quotes_are_located_once(spark, sf_dir):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(adapters.pages(spark, sf_dir)).count("split(") == 1
    assert plan(ground.ground(adapters.quotes(spark, sf_dir), adapters.pages(spark, sf_dir), "exact")).count("(?iu)") == 1
