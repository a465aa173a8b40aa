"""Candidate search and the numeric join against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from claimlink.jobs import catalogue
from claimlink.operators import link

FACT = "fact_id string, doc_id string, doc_seq int, kind string, attribute_key string, embedding array<float>"


def clustered(n=260, seed=1, clusters=8, width=6):
    """Unit vectors close about a few directions, some twice."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, width))
    rows = []
    for i in range(n):
        v = middle[i % clusters] + rng.normal(scale=0.15, size=width)
        v = np.float32(v / np.linalg.norm(v))
        doc = int(rng.integers(0, 6))
        rows.append((f"f{i:04}", f"d{doc}", doc, ["numeric", "statement"][i % 5 == 0], f"k{i % 3}" if i % 9 else None, v.tolist()))
    return rows + [(f"g{i}", "d9", 9, "numeric", "k1", rows[i][5]) for i in range(12)]


def alike(rows, threshold, mode, asking=None, looked_at=15, neighbours=5):
    out = set()
    vectors = {r[0]: np.float64(r[5]) for r in rows if r[5]}
    for a in rows:
        if a[0] not in vectors or (asking is not None and a[0] not in asking):
            continue
        near = [(-float(vectors[a[0]] @ vectors[b[0]]), b[0], b[3]) for b in rows if b[0] in vectors and (b[2] < a[2] if mode == "incremental" else b[1] != a[1])]
        near = [x for x in sorted(near)[:looked_at] if -x[0] >= threshold and x[2] == a[3]]
        out |= {(a[0], b, round(-s, 5)) for s, b, _ in near[:neighbours]}
    return out


def rounded(df):
    return {(r.fact_id, r.other_id, round(r.sim, 5)) for r in df.collect()}


@pytest.mark.parametrize(("threshold", "mode", "blocks"), [(0.86, "relink", 0), (0.86, "relink", 12), (0.95, "incremental", 20), (-0.5, "relink", 9)])
def test_similarity_candidates_equal_all_pairs(spark, threshold, mode, blocks):
    rows = clustered()
    table = spark.createDataFrame(rows, FACT)
    assert rounded(link.similarity_candidates(table, threshold, mode=mode, blocks=blocks)) == alike(rows, threshold, mode) != set()


def test_blocks_out_of_reach_are_skipped(spark):
    rows = clustered(400, seed=3)
    placed, pivots = link._cells(spark.createDataFrame(rows, FACT).selectExpr("fact_id", "embedding AS v"), 16)
    dealt = [(r.fact_id, r.block, r.cell, r.angle, r.norm) for r in link._ring_blocks(placed, 20).collect()]
    blocks = sorted({r[1] for r in dealt})
    members = {b: [r for r in dealt if r[1] == b] for b in blocks}
    assert sum(map(len, members.values())) == len(rows)
    stats = [(m[0][2], min(r[3] for r in m), max(r[3] for r in m), max(r[4] for r in m)) for m in members.values()]
    near, vectors = link.near_blocks(stats, pivots, 0.9), {r[0]: np.float64(r[5]) for r in rows}
    matrix = {b: np.array([vectors[r[0]] for r in m]) for b, m in members.items()}
    met = {(i, int(j)) for i in range(len(blocks)) for j in near(i)}
    needed = {(i, j) for i, a in enumerate(blocks) for j, b in enumerate(blocks) if (matrix[a] @ matrix[b].T).max() >= 0.9}
    assert needed <= met and len(met) < 0.6 * len(blocks) ** 2
    assert all((j, i) in met for i, j in met)


def test_equal_vectors_are_spread(spark):
    rows = [(f"f{i:03}", f"d{i % 4}", i % 4, "numeric", "k", [0.6, 0.8]) for i in range(90)]
    placed, _ = link._cells(spark.createDataFrame(rows, FACT).selectExpr("fact_id", "embedding AS v"), 3)
    sizes = [r["count"] for r in link._ring_blocks(placed, 10).groupBy("block").count().collect()]
    assert sum(sizes) == 90 and max(sizes) < 30
    got = link.similarity_candidates(spark.createDataFrame(rows, FACT), 0.9, blocks=9)
    assert rounded(got) == alike([(*r[:5], list(np.float32(r[5]))) for r in rows], 0.9, "relink")


def test_only_asking_facts_get_candidates(spark):
    rows = clustered()
    table = spark.createDataFrame(rows, FACT)
    ask = {r[0] for r in rows if r[2] == 9}
    for blocks in (0, 15):
        got = link.similarity_candidates(table, 0.86, mode="incremental", blocks=blocks, asking=table.where("doc_seq = 9"))
        assert rounded(got) == alike(rows, 0.86, "incremental", ask) != set()
    assert link.similarity_candidates(table, 0.86, asking=table.limit(0)).count() == 0


def test_facts_without_vectors_and_vectors_of_other_lengths(spark):
    rows = clustered(60)
    odd = [("n1", "d1", 1, "numeric", "k1", None), ("n2", "d1", 1, "numeric", "k1", []), ("n3", "d2", 2, "numeric", "k1", [1.0, None])]
    table = spark.createDataFrame(rows + odd, FACT)
    assert rounded(link.similarity_candidates(table, 0.86)) == alike(rows, 0.86, "relink")
    assert link.similarity_candidates(table.limit(0)).count() == 0
    with pytest.raises(Exception, match="can't be compared"):
        link.similarity_candidates(spark.createDataFrame([*rows, ("x", "d1", 1, "numeric", "k", [1.0])], FACT), 0.86).collect()


def test_vectors_can_be_scaled_to_unit_length(spark):
    rows = clustered(80)
    long = [(*r[:5], [x * (1 + i % 4) for x in r[5]]) for i, r in enumerate(rows)]
    assert rounded(link.similarity_candidates(spark.createDataFrame(long, FACT), 0.9, normalise=True)) == alike(rows, 0.9, "relink")


def by_key(rows, mode, most=9, asking=None):
    out = set()
    for a in rows:
        if a[4] is None or (asking is not None and a[0] not in asking):
            continue
        near = [(-float(np.float64(a[5]) @ np.float64(b[5])) if a[5] and b[5] else 0.0, b[0]) for b in rows if (b[2] < a[2] if mode == "incremental" else b[1] != a[1]) and a[3:5] == b[3:5]]
        out |= {(a[0], b, round(-s, 5)) for s, b in sorted(near)[:most]}
    return out


@pytest.mark.parametrize("block", [2048, 7])
@pytest.mark.parametrize("mode", ["relink", "incremental"])
def test_key_candidates_of_large_and_small_keys(spark, block, mode):
    rows = [*clustered(150), ("n1", "d1", 1, "numeric", "k1", None), ("n2", "d0", 0, "numeric", "lone", None), ("n3", "d3", 3, "numeric", "lone", [1.0] * 6)]
    table = spark.createDataFrame(rows, FACT)
    assert rounded(link.key_candidates(table, mode, block=block)) == by_key(rows, mode) != set()
    ask = {r[0] for r in rows if r[2] == 9}
    assert rounded(link.key_candidates(table, mode, block=block, asking=table.where("doc_seq = 9"))) == by_key(rows, mode, asking=ask)
    assert link.key_candidates(table.limit(0), mode, block=block).count() == 0


VALUES = "id string, doc_id string, kind string, attribute_key string, unit string, scope string, basis string, period_start string, period_end string, value_norm double, value_text string, scale string"


@pytest.mark.parametrize("tolerance", [0.0, 0.01, 0.3, 0.999, 1.0, 2.0])
def test_numeric_matches_equal_all_pairs(spark, tolerance):
    rng = random.Random(7)
    near = [100.0, 100.5, 101.0, 99.0, 0.0, -0.0, -100.0, -100.7, 1e-9, 0.995e-9, 1.004e-9, 3e-12, -3e-12, 1e-11, 5e-300, 1e300, 1.005e300, float("nan"), float("inf"), None, 70.0, 0.7, 1.0]
    values = near + near[:8] + [rng.choice([1, -1]) * 10 ** rng.uniform(-12, -6) for _ in range(40)] + [100 * (1 + rng.uniform(-0.03, 0.03)) for _ in range(60)]
    rows = [(f"{i:03}", f"d{i % 5}", "numeric", "k", rng.choice(["INR", "", None]), rng.choice(["a", "A"]), rng.choice(["", "x"]), "2023-04-01", "2024-03-31", v, str(v), "none") for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, VALUES)
    expected = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            x, y = a[9], b[9]
            if a[1] == b[1] or x is None or y is None or (a[4] or "") != (b[4] or "") or not (a[6] == b[6] or not a[6] or not b[6]):
                continue
            if abs(x - y) / max(abs(x), abs(y), 1e-9) <= tolerance:
                expected.add((a[0], b[0]))
    assert {(r.fact_a, r.fact_b) for r in link.numeric_matches(table, tolerance).collect()} == expected != set()
    some = table.where("doc_id = 'd1'")
    got = [(r.fact_a, r.fact_b) for r in link.matches_of_new(some, table, tolerance).collect()]
    own = {r[0] for r in rows if r[1] == "d1"}
    assert len(got) == len(set(got)) and set(got) == {p for p in expected if own & set(p)}


def shuffled(spark, run):
    """Bytes that stages shuffle while run() runs."""
    context = spark.sparkContext
    store = context._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    context._jsc.sc().listenerBus().waitUntilEmpty()
    before = written()
    run()
    context._jsc.sc().listenerBus().waitUntilEmpty()
    return written() - before


def test_shuffle_does_not_grow_with_the_number_of_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(f"f{i:04}", f"d{i % 6}", i % 6, "numeric", "k", rng.normal(size=48).tolist()) for i in range(1600)]
    table = spark.createDataFrame(rows, FACT).persist()
    table.count()
    few, many = (shuffled(spark, lambda b=b: link.similarity_candidates(table, 20.0, blocks=b).count()) for b in (10, 120))
    table.unpersist()
    assert many < 2.5 * few


@pytest.mark.parametrize("least", [-np.inf, 0.0, 1.2])
@pytest.mark.parametrize("mode", ["relink", "incremental"])
def test_nearest_rows_equal_a_full_sort(monkeypatch, mode, least):
    monkeypatch.setattr(link, "AT_ONCE", 3000)
    rng = np.random.default_rng(2)
    for width in (4, 30, 900):
        x, y = (rng.integers(-1, 2, (n, 5)).astype(float) for n in (25, width))  # many ties
        doc, other_doc, rank = rng.integers(0, 4, 25), rng.integers(0, 4, width), rng.permutation(width)
        got = [tuple(map(float, t)) for cells in link._nearest(x, y, doc, other_doc, rank, mode, 3, least) for t in zip(*cells, strict=True)]
        expected = []
        for i in range(25):
            ok = [k for k in range(width) if (other_doc[k] < doc[i] if mode == "incremental" else other_doc[k] != doc[i]) and x[i] @ y[k] >= least]
            expected += [(i, k, float(x[i] @ y[k])) for k in sorted(ok, key=lambda k: (-(x[i] @ y[k]), rank[k]))[:3]]
        assert got == expected


def test_shuffle_of_keys_does_not_grow_with_small_blocks(spark):
    rows = clustered(1500, width=24)
    table = spark.createDataFrame([(*r[:4], "k", r[5]) for r in rows], FACT).persist()
    table.count()
    usual, one = (shuffled(spark, lambda b=b: link.key_candidates(table, **b).count()) for b in ({}, {"block": 4096}))
    table.unpersist()
    assert usual < 1.5 * one and link.KEY_BLOCK > link.BLOCK


def test_keys_without_any_vectors_have_candidates(spark):
    rows = [(f"f{i:02}", f"d{i % 3}", i % 3, "numeric", f"k{i % 2}", [None, []][i % 2]) for i in range(20)]
    for mode in ("relink", "incremental"):
        assert rounded(link.key_candidates(spark.createDataFrame(rows, FACT), mode)) == by_key(rows, mode) != set()


def test_equal_vectors_have_equal_products_and_large_ones_are_compared(monkeypatch):
    monkeypatch.setattr(link, "AT_ONCE", 3000)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 37))
    for scale in (1.0, 1e-25, 1e20, 1e90):
        x, y = base[:25] * scale, np.concatenate([base[rng.integers(0, 40, 800)], base + 1e-9 * rng.normal(size=base.shape)]) * scale
        doc, other_doc, rank = rng.integers(0, 4, 25), rng.integers(0, 4, len(y)), rng.permutation(len(y))
        for most, least in ((9, -np.inf), (15, 5.0 * scale * scale)):
            got = [tuple(map(int, t)) for r, c, _ in link._nearest(x, y, doc, other_doc, rank, "relink", most, least) for t in zip(r, c, strict=True)]
            sims = np.einsum("ik,jk->ijk", x, y).sum(axis=2)
            expected = [(i, int(k)) for i in range(25) for k in [k for k in np.lexsort((rank, -sims[i])) if other_doc[k] != doc[i] and sims[i, k] >= least][:most]]
            assert got == expected != []


def test_vectors_do_not_move_to_meet_their_rings(spark, monkeypatch):
    monkeypatch.setattr(link, "PAIRS", 1)
    rng = np.random.default_rng(6)
    rows = [(f"f{i:04}", f"d{i % 6}", i % 6, "numeric", "k", rng.normal(size=256).tolist()) for i in range(2000)]
    table = spark.createDataFrame(rows, FACT).persist()
    table.count()
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the facts were too many
    try:
        moved = shuffled(spark, lambda: link.similarity_candidates(table, 150.0).count())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
        table.unpersist()
    assert moved < 6 * 2000 * 256 * 4  # to groups and to pairs of groups, on two sides


def test_shuffle_of_open_pairs_grows_as_the_facts_do(spark, monkeypatch):
    monkeypatch.setattr(link, "BLOCK", 64)
    rng = np.random.default_rng(8)
    rows = [(f"f{i:04}", f"d{i % 6}", i % 6, "numeric", f"k{i % 40}", rng.normal(size=64).tolist()) for i in range(3600)]
    known = spark.createDataFrame([("f0000", "f0001")], "fact_a string, fact_b string")
    moved = []
    for n in (1200, 3600):
        table = spark.createDataFrame(rows[:n], FACT).persist()
        table.count()
        moved.append(shuffled(spark, lambda t=table: link.not_judged(link.rank_candidates(link.similarity_candidates(t, 30.0), link.key_candidates(t)), known).count()))
        table.unpersist()
    assert moved[1] < 4.5 * moved[0]


def test_open_pairs_make_their_facts_once(spark, monkeypatch, sf_dir):
    made, facts = spark.sparkContext.accumulator(0), catalogue.t.facts

    def counted(session, path):
        rows = facts(session, path)

        def pass_on(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(pass_on, rows.schema)

    monkeypatch.setattr(catalogue.t, "facts", counted)
    assert catalogue.open_pairs(spark, sf_dir).count() > 0
    assert made.value == facts(spark, sf_dir).count()


def test_asking_facts_of_a_hot_key_move_once(spark):
    rng = np.random.default_rng(9)
    rows = [(f"f{i:04}", f"d{i % 6}", i % 6, "numeric", "k", rng.normal(size=96).tolist()) for i in range(2000)]
    table = spark.createDataFrame(rows, FACT).persist()
    table.count()
    one, many = (shuffled(spark, lambda b=b: link.key_candidates(table, block=b).count()) for b in (4096, 200))
    table.unpersist()
    assert many < 3 * one


@pytest.mark.parametrize("mode", ["relink", "incremental"])
def test_parts_and_groups_of_a_key_equal_all_pairs(spark, monkeypatch, mode):
    rows = clustered()
    table = spark.createDataFrame(rows, FACT)
    for group_rows, parts in ((25, 11), (40, 2)):
        monkeypatch.setattr(link, "GROUP_ROWS", group_rows)
        monkeypatch.setattr(link, "MOST_PARTS", parts, raising=False)
        assert rounded(link.key_candidates(table, mode, block=10)) == by_key(rows, mode) != set()
        ask = {r[0] for r in rows if r[2] == 9}
        assert rounded(link.key_candidates(table, mode, block=10, asking=table.where("doc_seq = 9"))) == by_key(rows, mode, asking=ask)
