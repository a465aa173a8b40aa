"""Conversation repair, hard-negative mining and source mixing against brute force and SQL, with the odd rows that tables hold."""

from __future__ import annotations

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlink.llm import conversation_repair as repair
from claimlink.llm import hard_negatives, mixing

CHATS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def same(df, sql, **tables):
    names, rows = sql_rows(sql, **tables)
    clean = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert clean(df.select(*names).collect()) == clean(rows)
    return rows


# Conversation repair.


def cheapest(kinds):
    """(cost, letters) of the best edits by a search over (cost, letters), which needs no distances."""
    heap, seen = [(0, "", 0, repair.NOTHING)], set()
    while heap:
        cost, letters, row, state = heapq.heappop(heap)
        if (row, state) in seen:
            continue
        seen.add((row, state))
        if row == len(kinds) and state in (repair.NOTHING, repair.ASSISTANT):
            return cost, letters
        kind = kinds[row] if row < len(kinds) else None
        nxt = repair.ASSISTANT if state == repair.USER else repair.USER
        heapq.heappush(heap, (cost + 2, letters + "I", row, nxt))
        if kind:
            heapq.heappush(heap, (cost + 3, letters + "D", row + 1, state))
            if kind != "-":
                extra = kind.isupper()
                heapq.heappush(heap, (cost + 2 + extra, letters + "R", row + 1, nxt))
                to = {"s": repair.SYSTEM, "u": repair.USER, "a": repair.ASSISTANT}.get(kind.lower())
                if to is not None and (to == nxt or (to == repair.SYSTEM and state == repair.NOTHING)):
                    heapq.heappush(heap, (cost + extra, letters + "K", row + 1, to))


def test_op11_audits_are_the_least_of_the_cheapest():
    rng = random.Random(3)
    for _ in range(400):
        kinds = "".join(rng.choices("-suaxSUAX", weights=(2, 1, 5, 5, 1, 1, 2, 2, 1), k=rng.randint(0, 9)))
        found = repair.distances(kinds, repair.DONE)
        letters, _ = repair.walk(kinds, found, repair.DONE, repair.NOTHING)
        assert (found[0], letters) == cheapest(kinds)
        left = "".join((role or kinds[row].lower())[0] for row, role in repair.replay(letters, kinds, repair.NOTHING))
        assert re.fullmatch("(s?(ua)+)?", left)


def chats(n=40, seed=2):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None])
            text = rng.choice(["Yes.", "Why?", "no end", "", " \t", None, "line\nline!", "Ende ", f"Turn {turn}."])
            row = (conv, None if rng.random() < 0.1 else turn + (turn > 5) * rng.randint(0, 3), role, text)
            rows += [row] * rng.choice([1, 1, 1, 2, 3])
    return rows


@pytest.mark.parametrize("segment", [2048, 3, 1])
def test_op11_equals_sql_with_nulls_ties_and_segments(spark, monkeypatch, tmp_path, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    table = spark.createDataFrame(chats(), CHATS).withColumn("key", F.lit(1)).withColumn("cost", F.lit("x"))
    table.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op11_conversation_repair(spark, str(tmp_path))
    same(got, repair.OP11_SQL, conversations=table.toPandas().astype({"turn": "Int64", "conv_id": "Int64"}))


def test_op11_equals_sql_on_the_table(spark, duck, sf_dir):
    got = repair.op11_conversation_repair(spark, sf_dir)
    found = duck.execute(repair.OP11_SQL)
    assert sorted(map(tuple, got.select(*(d[0] for d in found.description)).collect())) == sorted(found.fetchall())


def test_op11_empty_table_and_a_conversation_that_loses_all_rows(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.")], CHATS).write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert [tuple(r) for r in repair.op11_conversation_repair(spark, f"{tmp_path}/a").collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    spark.createDataFrame([], CHATS).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert repair.op11_conversation_repair(spark, f"{tmp_path}/b").count() == 0


def test_op11_a_long_conversation_is_spread(spark):
    rng = random.Random(4)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"{'x' * rng.randint(0, 3000)} {i}{rng.choice(['.', ''])}") for i in range(6000)]
    table = spark.createDataFrame(rows, CHATS)
    found, turns = repair.repair_conversations(table.repartition(6))
    kinds = "".join(r[2][0] if r[3].endswith(".") else r[2][0].upper() for r in rows)
    assert [(r.cost, r.audit) for r in found.collect()] == [cheapest(kinds)]
    assert turns.select("part", "seg").distinct().count() >= 3
    left = [(r.role, r.text) for r in turns.orderBy("part", "seg", "pos").collect()]
    assert [r[0] for r in left] == ["user", "assistant"] * (len(left) // 2)
    digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in left).encode()).hexdigest()
    assert repair.digests(turns).first()["repaired_sha256"] == digest


# Hard negatives.

VECTORS = "vec_id long, embedding array<float>, label int"


def test_op12_equals_sql(spark, duck, sf_dir):
    found = duck.execute(hard_negatives.OP12_SQL).fetchall()
    assert sorted(map(tuple, hard_negatives.op12_hard_negatives(spark, sf_dir).collect())) == sorted(found) != []


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_op12_ties_nulls_repeated_rows_and_blocks(spark, monkeypatch, scale):
    rng = random.Random(8)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 9)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 2)
    good = [(i, [rng.choice([0.25, 0.5, 0.75]) * scale for _ in range(4)], i % 3) for i in range(70)]
    good += [good[3], good[20], (71, [0.5 * scale], 1)]
    odd = [(80, None, 1), (81, [None, 1.0], 1), (82, [float("nan"), 1.0], 2), (83, [float("inf")], 0), (None, [1.0] * 4, 1), (84, [1.0] * 4, None), (85, [], 1)]
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (4 - len(v)), y) for i, v, y in good]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    expected = collections.Counter()
    for anchor, v, label in {(i, tuple(v), y) for i, v, y in whole if i % 10 == 0}:
        ranked = sorted((-dot(v, w), i, y) for i, w, y in whole if i != anchor)
        for score, positive, _ in [r for r in ranked if r[2] == label][:5]:
            some = [r for r in ranked if r[2] != label and 50 * -score <= 100 * -r[0] <= 95 * -score][:3]
            expected.update((anchor, positive, n, i, -score, -s) for n, (s, i, _) in enumerate(some, 1))
    table = spark.createDataFrame(good + odd, VECTORS).withColumn("id", F.lit("x")).withColumn("rank", F.lit(0))
    got = hard_negatives.mine_hard_negatives(table, F.col("vec_id") % 10 == 0)
    assert collections.Counter(map(tuple, got.collect())) == expected and max(expected.values()) >= 1


def test_op12_few_or_no_rows_and_scores_that_are_too_large(spark):
    one = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], VECTORS)
    for table in (one, one.limit(0), one.where("vec_id = 1")):
        assert hard_negatives.mine_hard_negatives(table, F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(ValueError, match="long"):
        hard_negatives.mine_hard_negatives(spark.createDataFrame([(0, [1e9], 1)], VECTORS), F.lit(True))


# Mixing.

DOCS = "doc_id long, source string, text string"


def mixed_docs(seed=5):
    rng, rows = random.Random(seed), []
    for source, n in (("a", 300), ("b", 40), ("ä", 25), ("Z", 3), (None, 60), ("empty", 2), ("", 30)):
        for _ in range(n):
            size = 0 if source == "empty" else rng.choice([0, 1, 3, 10, 40, 200])
            rows.append((len(rows), source, None if size == 0 and rng.random() < 0.5 else "w x " * size))
    return rows + [rows[1]] * 4 + [(None, "a", "no id here")] * 3 + [(900, "b", "word " * 5000)]


def test_op13_equals_sql_with_nulls_ties_and_repeated_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "ROWS_AT_ONCE", 2)
    table = spark.createDataFrame(mixed_docs(), DOCS).withColumn("key", F.lit(1)).withColumn("size", F.lit("x")).withColumn("rows", F.lit(None).cast("int"))
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = same(mixing.op13_source_mixing(spark, str(tmp_path)), mixing.OP13_SQL, documents=table.toPandas().astype({"doc_id": "Int64"}))
    again = mixing.op13_source_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixing.op13_source_mixing(spark, str(tmp_path)).collect()))
    assert len(rows) == len(mixed_docs()) and all(r[4] <= 2 * r[1] for r in rows)


def test_op13_bins_of_the_ranking_are_refined(spark, duck, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_IN_BIN", 0)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    got = mixing.op13_source_mixing(spark, sf_dir)
    found = duck.execute(mixing.OP13_SQL)
    assert sorted(map(tuple, got.select(*(d[0] for d in found.description)).collect())) == sorted(found.fetchall())


def test_op13_targets_and_totals(spark):
    table = spark.createDataFrame(mixed_docs(), DOCS)
    plan = mixing.plan_mix(table)
    by = {r.source: r for r in plan.groupBy("source").agg(F.first("source_size").alias("size"), F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("copies").alias("most")).collect()}
    sizes = collections.Counter()
    for _, source, text in mixed_docs():
        sizes[source] += len(WORD.findall(text or ""))
    weights = dict(zip(sorted(s for s in sizes if s is not None) + [None], (3, 1, 2) * 3, strict=False))
    open_, targets, left = set(sizes), {}, 1.5 * sum(sizes.values())
    while over := {s for s in open_ if left * weights[s] / sum(weights[x] for x in open_) >= 2 * sizes[s]}:
        targets |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
        left = 1.5 * sum(sizes.values()) - sum(targets.values())
    targets |= {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
    assert {s: (r.size, pytest.approx(r.target)) for s, r in by.items()} == {s: (sizes[s], t) for s, t in targets.items()}
    assert all(abs(r.taken - r.target) <= 0.02 * r.target + 5 for s, r in by.items() if s != "Z") and max(r.most for r in by.values()) == 2
    mix = mixing.take(table, plan)
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != ""))
    assert {r.source: r.n for r in mix.groupBy("source").agg(F.sum(words).alias("n")).collect() if r.n} == {s: r.taken for s, r in by.items() if r.taken}


def test_op13_importance_makes_inclusion_unequal(spark):
    rows = [(i, "s", "w " * 10, 1 + 3 * (i % 2)) for i in range(4000)] + [(4000 + i, "s", "w " * 10, 0) for i in range(400)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, f"{DOCS}, weight int"), percent=60, importance="weight")
    share = dict(plan.where("doc_id < 4000").groupBy(F.col("doc_id") % 2).agg(F.avg("copies")).collect())
    assert share[1] == pytest.approx(4 * share[0], rel=0.15) and plan.where("doc_id >= 4000 AND copies > 0").isEmpty()
    assert plan.agg(F.sum(F.col("copies") * F.col("size"))).first()[0] == 0.6 * 44_000
    full = mixing.plan_mix(spark.createDataFrame(rows, f"{DOCS}, weight int"), percent=150, importance="weight")
    assert full.agg(F.max("copies"), F.sum(F.col("copies") * F.col("size"))).first() == (2, 66_000)


def test_op13_empty_table_and_long_text(spark):
    assert mixing.plan_mix(spark.createDataFrame([], DOCS)).count() == 0
    long = spark.createDataFrame([(1, "s", "wörd\x0b" * 400_000), (2, "s", None)], DOCS)
    assert {(r.doc_id, r.size, r.copies) for r in mixing.plan_mix(long).collect()} <= {(1, 400_000, 1), (1, 400_000, 2), (2, 0, 1), (2, 0, 2)}
