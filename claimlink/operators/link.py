"""Linking facts of different documents: candidates by key and by vector, arithmetic, and the upsert of relations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlink.operators.chunks import pack_groups
from claimlink.sources.schemas import RELATION_TYPES

#: Same-kind neighbours of a fact, how many vectors are looked at for them, and candidates of a fact after ranking.
NEIGHBOURS, LOOKED_AT, CANDIDATES = 5, 15, 9
SIMILARITY, TOLERANCE = 0.86, 0.01
#: Vectors of a block, more where there would be over MOST_BLOCKS of them, and fewer in small tables, so that there are SPREAD blocks of
#: LEAST vectors at least. Pivots about which blocks lie.
BLOCK, MOST_BLOCKS, MOST_PIVOTS, SPREAD, LEAST = 2048, 16_384, 1024, 24, 256
#: Pairs of groups of blocks that a search is dealt to; what a group holds at most, in facts and in bytes of vectors.
PAIRS, GROUP_ROWS, GROUP_BYTES = 128, 131_072, 1 << 26
#: Asking facts of a large key's part, and parts of a key until they are full groups.
KEY_BLOCK, MOST_PARTS = 32_768, 11
#: Products that are computed at once and rows of these, and columns of which only the best one bounds a row's best from below.
AT_ONCE, ROWS_AT_ONCE, FOLDED = 1 << 20, 512, 32
#: Norms up to which products are first computed in single precision, and pairs whose vectors are gathered at once for double precision.
MOST_SINGLE, GATHERED = 1e30, 1 << 15


def document_sequence(documents: DataFrame) -> DataFrame:
    """documents with doc_seq, their order of arrival. One row for each document, ordered in one task."""
    return documents.withColumn("doc_seq", F.row_number().over(Window.orderBy("created_at", "doc_id")))


def _older(mode: str) -> Column:
    """Which facts b a fact a is linked to: those of earlier documents, or those of all others."""
    return F.col("b_seq") < F.col("a_seq") if mode == "incremental" else F.col("a_doc") != F.col("b_doc")


def unit_length(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-9)))


def _as_floats(facts: DataFrame) -> Column:
    """The embeddings as they are if they are of floats, which take half of what doubles do; else as doubles."""
    return F.col("embedding") if dict(facts.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _asking(rows: DataFrame, asking: DataFrame | None) -> DataFrame:
    """rows with asks: whether a fact looks for candidates; by default all do."""
    if asking is None:
        return rows.withColumn("asks", F.lit(True))
    return rows.join(asking.select("fact_id").distinct().withColumn("asks", F.lit(True)), "fact_id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of a matrix; an error if their lengths differ."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    sizes = np.diff(np.asarray(column.offsets))
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} components can't be compared")
    return flat.reshape(len(sizes), -1)


def _documents(a: pa.Table, b: pa.Table, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """What of two tables' documents is compared, as numbers: their order of arrival, or which one it is."""
    if mode == "incremental":
        return tuple(t.column("doc_seq").to_pandas().to_numpy() for t in (a, b))
    both = pa.chunked_array([*a.column("doc_id").chunks, *b.column("doc_id").chunks], pa.string()).combine_chunks()
    codes = both.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[: a.num_rows], codes[a.num_rows :]


def _name_ranks(names: pa.ChunkedArray) -> np.ndarray:
    """Each name's place in the order of names; equal ones may have unequal places."""
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(np.array(names.to_pylist(), object), kind="stable")] = np.arange(len(names))
    return rank


def _rough(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """x and y in single precision, unless they are too long for it, and by how much a product of theirs may be off."""
    longest = [float(np.sqrt(np.einsum("ij,ij->i", m, m).max(initial=0.0))) for m in (x, y)]
    product = longest[0] * longest[1]
    if product <= MOST_SINGLE and max(longest) <= MOST_SINGLE:
        return x.astype(np.float32), y.astype(np.float32), (x.shape[1] + 4) * (2.0**-22 * product + 1e-37 * (1 + sum(longest)))
    return x, y, (x.shape[1] + 4) * 2.0**-50 * product if np.isfinite(product) else 0.0


def _products(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The products of these rows of x and y, equal ones for equal vectors wherever they stand."""
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[rows[k : k + GATHERED]], y[cols[k : k + GATHERED]]) for k in range(0, len(rows), GATHERED))])


def _first(rows: np.ndarray, cols: np.ndarray, found: np.ndarray, rank: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the most with the highest products, in order."""
    order = np.lexsort((rank[cols], -found, rows))
    rows, cols, found = rows[order], cols[order], found[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < most
    return rows[first], cols[first], found[first]


def _nearest(x: np.ndarray, y: np.ndarray, doc: np.ndarray, other_doc: np.ndarray, rank: np.ndarray, mode: str, most: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, product): for each row of x the most rows of y of other (or earlier) documents with the highest products of
    least or more, ties by rank.

    Products are computed in single precision, some rows and columns at a time; those that may be among a row's most so far are computed
    anew in double precision. Where too many may be, a row's bound is raised first: the columns are folded into fewer, of each of which
    the best one counts, and the most-th of these is no more than the row's most-th."""
    short, other_short, off = _rough(x, y)
    height = max(1, min(len(x), ROWS_AT_ONCE))
    width = max(1, min(len(y), AT_ONCE // height))
    space = np.empty((height, width), short.dtype)
    for at in range(0, len(x), height):
        own = doc[at : at + height]
        bound = np.full(len(own), least, float)
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        waiting = 0
        for start in range(0, len(y), width):
            part, of = other_short[start : start + width], other_doc[start : start + width]
            sims = np.matmul(short[at : at + height], part.T, out=space if (len(own), len(part)) == space.shape else None)
            at_least = (bound - off).astype(sims.dtype)
            if off:
                at_least = np.nextafter(at_least, sims.dtype.type(-np.inf))
            if sims.dtype == np.float64:
                sims[np.isnan(sims)] = -np.inf
            enough = sims >= at_least[:, None]
            if np.count_nonzero(enough) > 16 * most * len(sims):
                sims[~(of < own[:, None] if mode == "incremental" else of != own[:, None])] = -np.inf
                fold = max(most, len(part) // FOLDED)
                if len(part) >= fold:
                    heads = sims[:, : len(part) // fold * fold].reshape(len(sims), -1, fold).max(axis=1)
                    raised = np.partition(heads, fold - most, axis=1)[:, fold - most].astype(float)
                    at_least = np.maximum(at_least, np.nextafter((raised - 2 * off).astype(sims.dtype), sims.dtype.type(-np.inf)))
                    enough = sims >= at_least[:, None]
            rows, cols = np.divmod(np.flatnonzero(enough), len(part))
            ok = of[cols] < own[rows] if mode == "incremental" else of[cols] != own[rows]
            rows, cols = rows[ok], cols[ok] + start
            found = _products(x, y, at + rows, cols)
            ok = found >= bound[rows]
            kept.append((rows[ok], cols[ok], found[ok]))
            waiting += len(kept[-1][0])
            if waiting > 2 * most * len(own) or start + width >= len(y):
                rows, cols, found = _first(*(np.concatenate(c) for c in zip(*kept, strict=True)), rank, most)
                kept, waiting = [(rows, cols, found)], 0
                last = np.flatnonzero(np.arange(len(rows)) - np.searchsorted(rows, rows) == most - 1)
                bound[rows[last]] = found[last]
        rows, cols, found = kept[0]
        yield rows + at, cols, found


def _dealt_groups(sizes: np.ndarray, order: np.ndarray, n_groups: int) -> np.ndarray:
    """The group of each block: neighbours in order, about equal numbers of facts in each."""
    upto = np.cumsum(sizes[order])
    out = np.empty(len(sizes), int)
    out[order] = np.minimum((upto - sizes[order] / 2) * n_groups // max(1, upto[-1]), n_groups - 1)
    return out


def _cells(facts: DataFrame, n_pivots: int) -> DataFrame:
    """facts with cell, the pivot that is the nearest by angle, angle to it and norm. Pivots are the facts with the n_pivots smallest hashes."""
    rows = facts.select("v").orderBy(F.xxhash64("fact_id"), "fact_id").limit(n_pivots).collect()
    pivots = np.array([r[0] for r in rows], np.float64) if len({len(r[0]) for r in rows}) == 1 else None
    unit = None if pivots is None else pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in facts.schema)}, cell int, angle double, norm double"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column("v"))
            if unit is None or len(v) and v.shape[1] != unit.shape[1]:
                raise ValueError("vectors of different lengths can't be compared")
            norm = np.linalg.norm(v, axis=1)
            cosines = v @ unit.T / np.maximum(norm, 1e-300)[:, None] if len(v) else np.zeros((0, 1))
            cell = cosines.argmax(axis=1) if len(v) else np.zeros(0, int)
            angle = np.arccos(np.clip(cosines[np.arange(len(v)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle), pa.array(norm)], names=[*batch.schema.names, "cell", "angle", "norm"])

    return facts.mapInArrow(place, schema), unit


def _ring_blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows (cell, angle, ...) with block, a text: consecutive rings about a cell's pivot, of about size rows each. A ring of more
    rows is dealt to several blocks by hash."""
    ring = F.floor(F.col("angle") * 512).cast("int")
    counts = rows.groupBy("cell", ring.alias("ring")).agg(F.count("*").alias("rows_of_ring"))
    upto = F.sum("rows_of_ring").over(Window.partitionBy("cell").orderBy("ring"))
    starts = counts.select("cell", "ring", "rows_of_ring", (upto - F.col("rows_of_ring")).alias("start"))
    met = rows.withColumn("ring", ring).join(F.broadcast(starts), ["cell", "ring"])  # 1,609 rings a pivot at most; vectors stay where they are
    place = F.col("start") + F.pmod(F.xxhash64("fact_id"), F.col("rows_of_ring"))
    return met.withColumn("block", F.concat_ws("-", "cell", F.floor(place / size))).drop("ring", "rows_of_ring", "start")


def near_blocks(stats: list, pivots: np.ndarray, threshold: float) -> Callable[[int], np.ndarray]:
    """stats (cell, low, high, norm) of blocks -> which blocks may hold a vector whose product with one of block i reaches the threshold.

    Angles are a metric: two vectors are at least as far apart as their pivots, less their own distances from these, and, with the
    first one's pivot, as the other's pivot less its distance is beyond the first one's ring. A product that reaches the threshold
    needs an angle whose cosine is the threshold over both norms.
    """
    cell = np.array([s[0] for s in stats], int)
    low, high, norm = (np.array([s[k] for s in stats], float) for k in (1, 2, 3))
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1))

    def of(i: int) -> np.ndarray:
        between = apart[cell[i], cell]
        # what lies between the ring of i and the other block's, seen from either pivot
        gap = np.maximum.reduce([between - high[i] - high, low - between - high[i], low[i] - between - high])
        gap = np.where(cell == cell[i], np.maximum.reduce([gap, low - high[i], low[i] - high]), gap)
        cosine = threshold / np.maximum(norm[i] * norm, 1e-300)
        return np.flatnonzero((cosine <= 1) & (gap <= np.arccos(np.clip(cosine, -1, 1)) + 1e-7))

    return of


def similarity_candidates(
    facts: DataFrame, threshold: float = SIMILARITY, neighbours: int = NEIGHBOURS, looked_at: int = LOOKED_AT, mode: str = "relink", blocks: int = 0, asking: DataFrame | None = None, normalise: bool = False,
) -> DataFrame:
    """(fact_id, other_id, sim): among a fact's looked_at nearest facts of other documents, the nearest neighbours of its own kind.

    facts: fact_id, doc_id, doc_seq, kind, embedding. Only pairs that reach the threshold count, so vectors are dealt into blocks, rings
    about pivots, and only pairs of blocks that may hold such a pair are multiplied. What is shuffled are blocks in groups, as pairs of a
    group that asks and one that answers: about PAIRS of them however many facts there are, until a group would be over its bounds, so
    the shuffle grows as the facts do. A block goes to those groups only that have a partner for it. Each pair of groups keeps the best
    looked_at of each row.

    Facts whose embedding is null, empty or has a null have no candidates and are none; vectors of different lengths are an error.
    blocks: their number; 0: by the number of facts, MOST_BLOCKS at most, as their bounds are known to every task. asking: the facts
    (fact_id) that look for candidates; by default all. normalise: first scale vectors to unit length.
    """
    has = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull()), F.lit(False))
    vector = unit_length(F.col("embedding")) if normalise else _as_floats(facts)
    rows = facts.where(has).select("fact_id", "doc_id", "doc_seq", "kind", vector.alias("v"))
    empty = facts.select("fact_id", F.col("fact_id").alias("other_id"), F.lit(0.0).alias("sim")).limit(0)
    n, longest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return empty
    size = -(-n // blocks) if blocks else max(min(BLOCK, max(LEAST, -(-n // SPREAD))), -(-n // MOST_BLOCKS))
    placed, pivots = _cells(rows, min(MOST_PIVOTS, -(-n // size)))
    dealt = _asking(_ring_blocks(placed, size), asking)
    stats = dealt.groupBy("block", "cell").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.max("norm").alias("norm"), F.count("*").alias("n"), F.count_if("asks").alias("asking")
    ).collect()
    names, sizes, askers = [s["block"] for s in stats], np.array([s["n"] for s in stats]), np.array([s["asking"] for s in stats])
    if not askers.any():
        return empty
    near = near_blocks([(s["cell"], s["low"], s["high"], s["norm"]) for s in stats], pivots, threshold)
    fit = max(1, min(GROUP_ROWS, GROUP_BYTES // (8 * longest)))
    # a fact that asks is shuffled once for each group that answers, with its results, which weigh as much as three vectors
    n_asking = max(-(-int(askers.sum()) // fit), round(math.sqrt(4 * PAIRS * askers.sum() / n)), 1)
    n_answering = max(-(-n // fit), -(-PAIRS // n_asking))
    order = np.lexsort(([s["low"] for s in stats], [s["cell"] for s in stats]))
    group, lane = _dealt_groups(askers, order, n_asking), _dealt_groups(sizes, order, n_answering)

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column(0).to_pylist():
                met, sides = np.zeros(len(names), bool), []
                for i in np.flatnonzero((group == g) & (askers > 0)).tolist():
                    met[found := near(i)] = True
                    sides += [(0, i, k) for k in np.unique(lane[found]).tolist()]
                sides += [(1, j, int(lane[j])) for j in np.flatnonzero(met).tolist()]
                side, at, k = (pa.array(c, pa.int32()) for c in (zip(*sides, strict=True) if sides else ([], [], [])))
                yield pa.RecordBatch.from_arrays([side, at, pa.array([names[i] for i in at.to_pylist()], pa.string()), pa.array([g] * len(sides), pa.int32()), k], names=["side", "at", "block", "i", "j"])

    asked = facts.sparkSession.createDataFrame([(g,) for g in sorted(set(group[askers > 0].tolist()))], "g int")
    pairs = asked.mapInArrow(partners, "side int, at int, block string, i int, j int")
    columns = [F.col(c).alias(c) for c in ("i", "j", "at", "fact_id", "doc_seq" if mode == "incremental" else "doc_id", "kind", "v")]
    left = dealt.where("asks").join(pairs.where("side = 0"), "block").select(*columns)
    right = dealt.join(pairs.where("side = 1"), "block").select(*columns)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if a.num_rows and b.num_rows:
            x, y = _vectors(a.column("v")), _vectors(b.column("v"))
            (doc, other_doc), rank = _documents(a, b, mode), _name_ranks(b.column("fact_id"))
            block, other_block = (t.column("at").to_numpy() for t in (a, b))
            for i in np.unique(block).tolist():
                mine, theirs = np.flatnonzero(block == i), np.flatnonzero(np.isin(other_block, near(i)))
                for cells in _nearest(x[mine], y[theirs] if len(theirs) < len(y) else y, doc[mine], other_doc[theirs], rank[theirs], mode, looked_at, threshold):
                    for cell, part in zip(out, (mine[cells[0]], theirs[cells[1]], cells[2]), strict=True):
                        cell.append(part)
        at, other, sims = (np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True))
        kind, other_kind = (np.array(t.column("kind").take(pa.array(k)).to_pylist(), object) for t, k in ((a, at), (b, other)))
        ids = [t.column("fact_id").take(pa.array(k)).cast(pa.string()) for t, k in ((a, at), (b, other))]
        return pa.table({"fact_id": ids[0], "other_id": ids[1], "sim": pa.array(sims), "same_kind": pa.array((kind == other_kind).astype(bool))})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, "fact_id string, other_id string, sim double, same_kind boolean")
    order = Window.partitionBy("fact_id").orderBy(F.desc("sim"), "other_id")
    found = found.withColumn("r", F.row_number().over(order)).where((F.col("r") <= looked_at) & F.col("same_kind"))
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= neighbours).select("fact_id", "other_id", "sim")


def key_candidates(facts: DataFrame, mode: str = "relink", most: int = CANDIDATES, block: int = KEY_BLOCK, asking: DataFrame | None = None) -> DataFrame:
    """(fact_id, other_id, sim): for each fact the nearest facts of other documents with the same attribute key and kind.

    Of a key with more than block facts those that ask are dealt to parts of about block facts, and those that answer to as few groups
    as their bounds allow, so that a fact that asks, and its results, move once up to GROUP_ROWS facts (fewer if vectors are long). There
    are at most MOST_PARTS parts until these reach the same bounds. A part meets each group, and they are multiplied, a few rows at a time,
    of which the best most of each row are kept, which hold the best of all. Smaller keys share groups by hash. A fact without a vector
    has similarity 0 to all. asking: the facts that look for candidates; by default all.
    """
    vector = _as_floats(facts)
    zero = F.array().cast(dict(facts.select(vector.alias("v")).dtypes)["v"])
    has = F.coalesce(F.forall("embedding", lambda x: x.isNotNull()), F.lit(False))
    rows = facts.where("attribute_key IS NOT NULL AND kind IS NOT NULL").select("fact_id", "doc_id", "doc_seq", "attribute_key", "kind", F.when(has, vector).otherwise(zero).alias("v"))
    counted = _asking(rows.withColumn("width", F.size("v")).drop("v"), asking)
    sizes = counted.groupBy("attribute_key", "kind").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking"), F.max("width").alias("longest"))
    n, longest = sizes.agg(F.sum("n"), F.max("longest")).first()
    n_groups = max(1, -(-(n or 0) // min(block, BLOCK)))
    fit = max(1, min(GROUP_ROWS, GROUP_BYTES // (8 * max(1, longest or 0))))
    block = max(1, min(block, fit))
    parts = F.greatest(F.ceil(F.col("asking") / fit), F.least(F.ceil(F.col("asking") / block), F.lit(MOST_PARTS)), F.lit(1))
    large = sizes.where(F.col("n") > block).select("attribute_key", "kind", parts.cast("int").alias("parts"), F.ceil(F.col("n") / fit).cast("int").alias("groups"))
    rows = _asking(rows.join(F.broadcast(large), ["attribute_key", "kind"], "left"), asking)  # so that a key's facts don't meet in a task
    hashed = F.xxhash64("attribute_key", "kind")
    rows = rows.withColumn("g", F.when(F.col("parts").isNull(), F.pmod(hashed, F.lit(n_groups))).otherwise(hashed))
    own = lambda seed, of: F.pmod(F.xxhash64("fact_id", F.lit(seed)), F.coalesce(of, F.lit(1))).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.coalesce(of, F.lit(1)) - 1))
    columns = [*(F.col(c).alias(c) for c in ("g", "i", "j", "fact_id", "doc_id", "doc_seq", "v")), F.struct("attribute_key", "kind").alias("of")]
    left = rows.where("asks").withColumn("i", own(1, "parts")).withColumn("j", each("groups")).select(*columns)
    right = rows.withColumn("j", own(2, "groups")).withColumn("i", each("parts")).select(*columns)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if a.num_rows and b.num_rows:
            mine, theirs = ([tuple(k.values()) for k in t.column("of").to_pylist()] for t in (a, b))
            at: dict[tuple, tuple[list[int], list[int]]] = {k: ([], []) for k in set(mine) & set(theirs)}
            for side, keys in enumerate((mine, theirs)):
                for row, k in enumerate(keys):
                    if k in at:
                        at[k][side].append(row)
            (doc, other_doc), rank = _documents(a, b, mode), _name_ranks(b.column("fact_id"))
            for pair in at.values():
                left_rows, right_rows = (np.array(rows) for rows in pair)
                x, y = _filled(a.column("v").take(pa.array(left_rows)), b.column("v").take(pa.array(right_rows)))
                for cells in _nearest(x, y, doc[left_rows], other_doc[right_rows], rank[right_rows], mode, most, -np.inf):
                    for cell, part in zip(out, (left_rows[cells[0]], right_rows[cells[1]], cells[2]), strict=True):
                        cell.append(part)
        found, other, sims = (np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True))
        ids = [t.column("fact_id").take(pa.array(k)).cast(pa.string()) for t, k in ((a, found), (b, other))]
        return pa.table({"fact_id": ids[0], "other_id": ids[1], "sim": pa.array(sims)})

    pairs = left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInArrow(best, "fact_id string, other_id string, sim double")
    order = Window.partitionBy("fact_id").orderBy(F.desc("sim"), "other_id")
    return pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("fact_id", "other_id", "sim")


def _filled(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Both columns as rows of matrices; empty vectors are rows of zeros."""
    there = [np.asarray(x.combine_chunks().value_lengths()) > 0 for x in (a, b)]
    found = [_vectors(c.filter(pa.array(t))) if t.any() else None for c, t in zip((a, b), there, strict=True)]
    widths = {v.shape[1] for v in found if v is not None}
    if len(widths) > 1:
        raise ValueError("vectors of different lengths can't be compared")
    out = [np.zeros((len(t), max(widths, default=1))) for t in there]
    for m, v, t in zip(out, found, there, strict=True):
        if v is not None:
            m[t] = v
    return out[0], out[1]


def rank_candidates(similar: DataFrame, keyed: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(fact_id, other_id, sim, via, rank): both kinds of candidates without repeats, the most similar ones of each fact."""
    both = similar.withColumn("via", F.lit("similarity")).unionByName(keyed.withColumn("via", F.lit("key")))
    both = both.groupBy("fact_id", "other_id").agg(F.max("sim").alias("sim"), F.max("via").alias("via"))
    order = Window.partitionBy("fact_id").orderBy(F.desc("sim"), "other_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def as_pairs(candidates: DataFrame) -> DataFrame:
    """One row (fact_a, fact_b) for each pair, the smaller id first, whichever of the two asked for it."""
    return candidates.select(F.least("fact_id", "other_id").alias("fact_a"), F.greatest("fact_id", "other_id").alias("fact_b")).dropDuplicates()


def not_judged(candidates: DataFrame, relations: DataFrame) -> DataFrame:
    """Candidates whose pair has no relation yet."""
    sorted_ = candidates.withColumn("fact_a", F.least("fact_id", "other_id")).withColumn("fact_b", F.greatest("fact_id", "other_id"))
    return sorted_.join(relations.select("fact_a", "fact_b"), ["fact_a", "fact_b"], "left_anti").drop("fact_a", "fact_b")


def agree(a: str, b: str, tolerance: float = TOLERANCE) -> Column:
    """Whether two facts' values agree, null-safe: unit, key, period and scope are equal, the bases don't exclude each other, and the gap is small."""
    f = lambda side, name: F.coalesce(F.col(f"{side}.{name}"), F.lit(""))
    lower = lambda side, name: F.lower(f(side, name))
    same = (f(a, "unit") == f(b, "unit")) & (f(a, "attribute_key") == f(b, "attribute_key")) & (lower(a, "scope") == lower(b, "scope"))
    period = (f(a, "period_start") != "") & (f(a, "period_end") != "") & (f(a, "period_start") == f(b, "period_start")) & (f(a, "period_end") == f(b, "period_end"))
    basis = (lower(a, "basis") == lower(b, "basis")) | (f(a, "basis") == "") | (f(b, "basis") == "")
    numeric = (f(a, "kind") == "numeric") & (f(b, "kind") == "numeric")
    return numeric & same & period & basis & F.coalesce(gap(a, b) <= tolerance, F.lit(False))


def gap(a: str, b: str) -> Column:
    x, y = F.col(f"{a}.value_norm"), F.col(f"{b}.value_norm")
    return F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-9))


def verdict(a: str = "a", b: str = "b") -> Column:
    """Why the values of two facts are held to agree, for a reader."""
    c = lambda side, name: F.coalesce(F.col(f"{side}.{name}").cast("string"), F.lit(""))
    unit = F.coalesce(F.nullif(F.col(f"{a}.unit"), F.lit("")), F.lit("-"))
    return F.concat(
        F.lit("Key "), c(a, "attribute_key"), F.lit(", period "), c(a, "period_start"), F.lit(" to "), c(a, "period_end"), F.lit(" and unit "), unit, F.lit(" are the same; "),
        c(a, "value_text"), F.lit(" ("), c(a, "scale"), F.lit(") and "), c(b, "value_text"), F.lit(" ("), c(b, "scale"), F.lit(") differ by "),
        F.format_string("%.2f%%", gap(a, b) * 100), F.lit("."),
    )


def _band(value: Column, tolerance: float) -> Column:
    """A whole number that differs by one at most between values whose gap is within the tolerance, null where no value can agree.

    Beyond the least denominator of a gap, agreeing values have logarithms that differ by tolerance / (1 - tolerance) at most; below
    it, they differ by the tolerance's share of it. Both scales are put together so that they meet there.
    """
    t, least = max(tolerance, 1e-6), 1e-9
    size = F.abs(value)
    scaled = F.when(size <= least, size / (t * least)).otherwise(1 / t + (F.log(size) - math.log(least)) * ((1 - t) / t))
    return F.when(size < float("inf"), F.floor(F.signum(value) * scaled * (1 - 1e-6)).cast("long"))


def _agreeing(asking: DataFrame, known: DataFrame, tolerance: float) -> DataFrame:
    """(a, b): facts of different documents whose values agree, as structs. The equal parts and the value's band are the join's keys;
    the asking side stands in the neighbouring bands too, so a hot key isn't compared pair by pair."""
    key = ["attribute_key", "unit", "period_start", "period_end", "scope_key"]
    used = ["id", "doc_id", "kind", "attribute_key", "unit", "period_start", "period_end", "scope", "basis", "value_norm", *(c for c in ("value_text", "scale") if c in asking.columns)]

    def side(facts: DataFrame, p: str) -> DataFrame:
        rows = facts.where("kind = 'numeric' AND value_norm IS NOT NULL AND coalesce(period_start, '') <> '' AND coalesce(period_end, '') <> ''").select(*used)
        rows = rows.withColumn("unit", F.coalesce("unit", F.lit(""))).withColumn("scope_key", F.lower(F.coalesce("scope", F.lit(""))))
        return rows.select(*key, *([_band(F.col("value_norm"), tolerance).alias("band")] if banded else []), F.struct(*used).alias(p))

    banded = tolerance < 1  # from 1 on all values of one sign agree
    left, right = side(asking, "a"), side(known, "b")
    if banded:
        left = left.withColumn("band", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))))
    return left.join(right, [*key, "band"] if banded else key).where("a.doc_id <> b.doc_id").where(agree("a", "b", tolerance))


def numeric_matches(facts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(fact_a, fact_b, delta, reasoning): numeric facts of different documents whose values agree."""
    pairs = _agreeing(facts, facts, tolerance).where("a.id < b.id")
    return pairs.select(F.col("a.id").alias("fact_a"), F.col("b.id").alias("fact_b"), gap("a", "b").alias("delta"), verdict().alias("reasoning"))


def matches_of_new(new: DataFrame, known: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(fact_a, fact_b, delta): pairs of a new fact and a known one of another document whose values agree. Only new facts are on
    the left side, so that what is known isn't compared with itself again."""
    pairs = _agreeing(new, known, tolerance)
    return pairs.select(F.least("a.id", "b.id").alias("fact_a"), F.greatest("a.id", "b.id").alias("fact_b"), gap("a", "b").alias("delta")).dropDuplicates(["fact_a", "fact_b"])


def fact_text(subject: Column, attribute: Column) -> Column:
    """What the sentence encoder sees of a fact."""
    return F.concat_ws(" | ", subject, attribute)


def judge_numeric(candidates: DataFrame, facts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """candidates with structs a and b and settled: whether arithmetic decides the pair."""
    side = lambda p, c: facts.select(F.col("id").alias(c), F.struct(*facts.columns).alias(p))
    return candidates.join(side("a", "fact_id"), "fact_id").join(side("b", "other_id"), "other_id").withColumn("settled", agree("a", "b", tolerance))


def deterministic_relations(judged: DataFrame) -> DataFrame:
    """The relations that arithmetic settles, one for each pair; doc_id is that of the fact that asked."""
    settled = judged.where("settled")
    return settled.select(
        F.least("fact_id", "other_id").alias("fact_a"), F.greatest("fact_id", "other_id").alias("fact_b"), F.lit("corroborates").alias("type"), F.lit(None).cast("string").alias("reconciliation"),
        F.lit(0.9).alias("confidence"), verdict().alias("reasoning"), F.lit("deterministic").alias("method"), (F.col("a.doc_id") != F.col("b.doc_id")).alias("cross_document"), F.col("a.doc_id").alias("doc_id"),
    ).dropDuplicates(["fact_a", "fact_b"])


def link_run(ranked: DataFrame, facts: DataFrame, relations: DataFrame, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """The relation table after a run over ranked candidates, and the pairs that arithmetic leaves to the judge: pairs that have a
    relation are passed over, those that arithmetic settles are added."""
    judged = judge_numeric(not_judged(ranked, relations), facts, tolerance)
    settled = deterministic_relations(judged).select(*relations.columns)  # none of these pairs has a relation yet
    return relations.unionByName(settled), judged.where("NOT settled")


def undecided_pairs(judged: DataFrame) -> DataFrame:
    """(fact_id, other_id, rank, doc_id, page_no, quote_start): pairs that arithmetic leaves open, each once, under the smaller id of the facts that ask for it."""
    row = F.struct("fact_id", "other_id", "rank", "a.doc_id", "a.page_no", "a.quote_start")
    pair = F.struct(F.least("fact_id", "other_id"), F.greatest("fact_id", "other_id"))
    return judged.where("NOT settled").groupBy(pair.alias("pair")).agg(F.min_by(row, "fact_id").alias("x")).select("x.*")


def judge_batches(judged: DataFrame, limit: int = 40) -> DataFrame:
    """(doc_id, batch, nth, fact_id, size): undecided pairs as groups of a fact and its candidates, packed into requests."""
    groups = undecided_pairs(judged).groupBy("doc_id", "page_no", "quote_start", "fact_id").agg((F.count("*") + 1).alias("size"))
    return pack_groups(groups, limit)


def batch_members(batches: DataFrame, judged: DataFrame) -> DataFrame:
    """(doc_id, batch, nth, place, fact_id): the facts of each request, group by group: the one that asks, then its candidates by rank."""
    first = batches.select("doc_id", "batch", "nth", F.lit(0).alias("place"), "fact_id")
    others = undecided_pairs(judged).select("fact_id", F.col("other_id").alias("other"), "rank")
    return first.unionByName(batches.join(others, "fact_id").select("doc_id", "batch", "nth", F.col("rank").alias("place"), F.col("other").alias("fact_id")))


def link_stats(facts: DataFrame, ranked: DataFrame, fresh: DataFrame, judged: DataFrame) -> DataFrame:
    """Counts of a link run for each document: new facts, candidates before and after leaving out judged pairs, groups and settled pairs."""
    measures = {
        "new_facts": facts.select(F.col("id").alias("fact_id")),
        "candidates": ranked.select("fact_id"),
        "not_judged": fresh.select("fact_id"),
        "settled": judged.where("settled").select("fact_id"),
        "groups": judged.where("NOT settled").select("fact_id").distinct(),
    }
    rows = reduce(DataFrame.unionByName, (df.withColumn("measure", F.lit(name)) for name, df in measures.items()))
    of = facts.select(F.col("id").alias("fact_id"), "doc_id")
    return rows.groupBy("fact_id", "measure").count().join(of, "fact_id").groupBy("doc_id").agg(*(F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("count"))), F.lit(0)).alias(m) for m in measures))


MEASURES = ("new_facts", "candidates", "already_judged", "groups", "llm_relations", "deterministic_relations")


def run_events(facts: DataFrame, found: DataFrame, relations: DataFrame, run: Column, judged: DataFrame | None = None) -> DataFrame:
    """(doc_id, run, measure, n): what a link run did for each document, as rows to append to the log of runs.

    facts: those of the run's documents; found: their ranked candidates with structs a and b, known and settled; relations
    (fact_a, fact_b): those that these documents had before; judged (doc_id, fact_a, fact_b): what the model has said of pairs that
    arithmetic hasn't settled. A pair counts once where both of its facts ask for it.
    """
    pair = F.struct(F.least("fact_id", "other_id"), F.greatest("fact_id", "other_id"))
    fresh = found.where("NOT known").select(F.col("a.doc_id").alias("doc_id"), "fact_id", "settled", pair.alias("pair"))
    once = fresh.groupBy("pair").agg(F.min(F.struct("doc_id", "fact_id", "settled")).alias("x")).select("x.*")
    of = facts.select("doc_id", F.col("id").alias("end"))
    ends = relations.select("fact_a", "fact_b", F.explode(F.array("fact_a", "fact_b")).alias("end")).join(of, "end").select("doc_id", "fact_a", "fact_b").distinct()
    counts = {
        "new_facts": facts.select("doc_id"),
        "candidates": found.select(F.col("a.doc_id").alias("doc_id")),
        "already_judged": ends.select("doc_id"),
        "groups": once.where("NOT settled").select("doc_id", "fact_id").distinct().select("doc_id"),
        "deterministic_relations": once.where("settled").select("doc_id"),
    } | ({} if judged is None else {"llm_relations": judged.select("doc_id")})
    rows = reduce(DataFrame.unionByName, (df.withColumn("measure", F.lit(name)) for name, df in counts.items()))
    return rows.groupBy("doc_id", "measure").agg(F.count("*").alias("n")).select("doc_id", run.alias("run"), "measure", "n")


def run_totals(events: DataFrame) -> DataFrame:
    """MEASURES of each document over all runs of the log. What there is of facts and of judged pairs is that of the last run; the
    others add up, as a run judges only pairs that none before it has judged."""
    last = F.max_by("n", "run")
    by = events.groupBy("doc_id", "measure").agg(F.sum("n").alias("sum"), last.alias("last"))
    n = F.when(F.col("measure").isin("new_facts", "already_judged"), F.col("last")).otherwise(F.col("sum"))
    return by.groupBy("doc_id").agg(*(F.coalesce(F.max(F.when(F.col("measure") == m, n)), F.lit(0)).alias(m) for m in MEASURES))


def validate_relations(responses: DataFrame, members: DataFrame) -> DataFrame:
    """responses (batch_id, position, a, b, type, reconciliation, confidence, reasoning) whose facts are of their batch and of different documents."""
    side = lambda c: members.select("batch_id", F.col("fact_id").alias(c), F.col("doc_id").alias(f"{c}_doc"))
    ok = responses.join(side("a"), ["batch_id", "a"]).join(side("b"), ["batch_id", "b"]).where("a <> b AND a_doc <> b_doc").where(F.col("type").isin(*RELATION_TYPES))
    return ok.select(
        "batch_id", "position", F.least("a", "b").alias("fact_a"), F.greatest("a", "b").alias("fact_b"), "type", F.nullif("reconciliation", F.lit("")).alias("reconciliation"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("reasoning", F.lit("")).alias("reasoning"), F.lit("llm").alias("method"), F.lit(True).alias("cross_document"),
    )


def upsert_relations(current: DataFrame, settled: DataFrame, judged: DataFrame) -> DataFrame:
    """The relation table after a run. Pairs that arithmetic settles are added where there is none; judged ones then replace what is
    there, but never an arithmetic verdict; of several judgements of a pair the last (batch_id, position) counts."""
    pair, columns = ["fact_a", "fact_b"], current.columns
    table = current.unionByName(settled.select(*columns).join(current.select(*pair), pair, "left_anti"))
    last = Window.partitionBy(*pair).orderBy(F.desc("batch_id"), F.desc("position"))
    fresh = judged.withColumn("r", F.row_number().over(last)).where("r = 1").select(*columns)
    fresh = fresh.join(table.where("method = 'deterministic'").select(*pair), pair, "left_anti")
    return table.join(fresh.select(*pair), pair, "left_anti").unionByName(fresh)
