"""What operators keep on disk while they run: shuffles end with their query, keys meet part by part, texts move once at a time."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

pytest.importorskip("claimlink.llm")
from claimlink.llm import jaccard_join, repeats, shared  # noqa: E402


@pytest.fixture
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_materialise_leaves_no_shuffle(spark):
    before = shuffle_files(spark)
    out = shared.materialise(spark.range(100_000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(100):  # files are deleted in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert sum(r["count"] for r in out.collect()) == 100_000
    shared.discard(out)


def test_keys_meet_part_by_part_and_are_deleted(spark, docs, monkeypatch):
    folder = shared.shared_folder(docs).removeprefix("file:")
    before, counts, columns = set(os.listdir(folder)), [], []
    stars, texts_of = jaccard_join.stars, jaccard_join.texts_of

    def counted(keyed, *others):
        counts.append(keyed.count())
        return stars(keyed, *others)

    def looked_at(*others):
        columns.extend(c for d in set(os.listdir(folder)) - before for c in spark.read.parquet(f"{folder}/{d}").columns)
        return texts_of(*others)

    monkeypatch.setattr(jaccard_join, "stars", counted)
    monkeypatch.setattr(jaccard_join, "texts_of", looked_at)
    assert jaccard_join.link_documents(docs).count() == docs.count()
    assert sum(counts) > 1_000 and max(counts) < 0.4 * sum(counts)
    assert columns and not [c for c in columns if c.startswith("keys")]


def test_each_key_is_in_one_part(docs):
    rows = [r for r in jaccard_join.digests(docs, 5, 80).collect() if r["sketch"]]
    bands = jaccard_join.Bands(80)
    sets = {jaccard_join.set_hash(x): x for x in jaccard_join.shingle_sets(shared.utf8(docs.toArrow().column("text").combine_chunks()), 5) if len(x)}
    for r in rows:
        parts = [r[c] for c in jaccard_join.KEY_PARTS]
        assert sorted(sum(parts, [])) == sorted(bands.keys(sets[r["node"]]).view("int64").tolist())
        assert all(k % (1 << 64) >> 62 == i for i, part in enumerate(parts) for k in part)


def test_repeats_are_decided_before_texts_move_again(docs):
    plan = repeats.mark_repeats(docs, cut_out=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "anchor" not in plan
