"""Removal of repeated byte strings of a minimum length, across and within documents.

Candidates: each window of min_bytes bytes has an anchor, the k-byte string in it with the least hash, so equal windows have equal
anchors. Consecutive windows with one anchor form a segment. One shuffle by anchor tells which segments meet others: segments
with an anchor of their own hold no repeated window.

The others are decided by their bytes: per group of anchors, these form one text whose suffixes are sorted; from its
Burrows-Wheeler transform, intervals of suffixes with a common prefix are extended backwards, breadth first, by STRIDE bytes a
level. So common prefixes come out in order of their length; intervals of one suffix are dropped, and the search stops at the
minimum length, where each interval holds the occurrences of one repeated window. Of a segment that occurs as a whole in many
documents the first two are in the text; what holds for the second holds for all further ones, so these needn't be moved.

An anchor with very many different segments (a phrase shorter than a window, in ever other surroundings) isn't sorted as one
group: its windows are dealt each by its own digest, so that equal ones still meet and no group has to be held in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from claimlink.llm.shared import STEP_BYTES, U64, Spans, arrow_batches, discard, materialise, mix, steps, text_rows, utf8

#: Bytes of an anchor, and by how many bytes a level extends prefixes; both at most the minimum length. STRIDE is two words of eight.
ANCHOR, STRIDE = 30, 16
#: Bytes whose suffixes are sorted at once, so few that four ranks fit in a key; a group of segments with one anchor stays together, up to GROUP of them.
SORT_BYTES = 60_000
#: Segments of one anchor, at most two of a kind, that are sorted as a group at most; beyond that their windows are dealt one by one.
GROUP = 1 << 10
#: Windows whose digests a task looks at together before they are dealt.
_DIGESTS = 1 << 16
_INDEX = 24
#: A place is (start << SHIFT) + number of windows; there are fewer than 1 << SHIFT windows in a segment.
SHIFT = 12


def segments(buffer: np.ndarray, ends: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor's hash, segment's hash) of the texts that end at ends in the buffer, one byte between two."""
    none = np.zeros(0, np.int64)
    k = min(ANCHOR, min_bytes)
    n = len(buffer) - min_bytes + 1
    if n <= 0:
        return none, none, none.view(U64), none.view(U64)
    spans = Spans(buffer)
    at = np.arange(len(buffer) - k + 1)
    hashes = mix(spans.of(at, at + k))
    least = (hashes >> U64(_INDEX) << U64(_INDEX)) | at.astype(U64)
    width, covered = min_bytes - k + 1, 1
    while covered < width:
        step = min(covered, width - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    anchor = (least[:n] & U64((1 << _INDEX) - 1)).astype(np.int64)
    length = np.diff(ends, prepend=-1) - 1
    end = np.repeat(ends, length + 1)[:n]
    window = np.flatnonzero(np.arange(n) + min_bytes <= end)
    if not len(window):
        return none, none, none.view(U64), none.view(U64)
    anchor = anchor[window]
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(window)) - 1
    low, high = window[first], window[last]
    return low, high - low + 1, hashes[anchor[first]], mix(spans.of(low, high + min_bytes))


def text_segments(texts: list[bytes], min_bytes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window in it, windows, anchor's hash, segment's hash), in parts of bounded size. Long texts are cut so that no window is lost."""
    for a, b in steps(texts):
        if b - a == 1 and len(texts[a]) > 4 * STEP_BYTES:
            whole = np.frombuffer(texts[a], np.uint8)
            for at in range(0, len(whole), 4 * STEP_BYTES):
                part = whole[at : at + 4 * STEP_BYTES + min_bytes - 1]
                low, count, anchor, own = segments(part, np.array([len(part)]), min_bytes)
                yield np.full(len(low), a), low + at, count, anchor, own
            continue
        ends = np.cumsum([len(t) + 1 for t in texts[a:b]]) - 1
        low, count, anchor, own = segments(np.frombuffer(b"\n".join(texts[a:b]), np.uint8), ends, min_bytes)
        text = np.searchsorted(ends, low, side="right")
        yield text + a, low - np.append(0, ends + 1)[text], count, anchor, own


def _without_copies(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch (id, u, text and any others) with one of each group of identical rows."""
    ids, u = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    if len(set(zip(ids, u, strict=True))) == len(ids):
        return batch
    first = {key: i for i, key in reversed(list(enumerate(zip(ids, u, batch.column(2).to_pylist(), strict=True))))}
    return batch.take(pa.array(sorted(first.values())))


def _places(docs: DataFrame, min_bytes: int) -> DataFrame:
    """anchor, s (the segment's hash), id, u and place of every segment. Where a batch holds a segment more than twice, only the
    first two are kept as they are; the others are known to be repeats and get a negative place and an anchor of their own. Of
    identical rows in a batch one gives segments; those in other batches give the same ones again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_without_copies, arrow_batches(batches)):
            ids, u = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order = np.empty(len(ids), np.int64)
            order[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, u[i]))] = np.arange(len(ids))
            parts = list(text_segments(utf8(batch.column(2)), min_bytes))
            if not parts:
                continue
            text, low, count, anchor, own = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.lexsort((low, order[text], own, anchor))
            text, low, count, anchor, own = (x[by] for x in (text, low, count, anchor, own))
            again = np.zeros(len(text), bool)
            again[2:] = (anchor[2:] == anchor[:-2]) & (own[2:] == own[:-2])
            place = low << SHIFT | count
            place[again] = ~place[again]
            anchor[again] = mix(mix(low[again].astype(U64)) + order[text[again]].astype(U64) + anchor[again])
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(own.view(np.int64)), batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)), pa.array(place)], names=["anchor", "s", "id", "u", "place"])

    return text_rows(docs).select("id", "u", "text").mapInArrow(run, f"anchor long, s long, id {docs.schema['id'].dataType.simpleString()}, u int, place long")


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and its inverse, suffixes ordered by their first depth bytes at least (the text's end is followed by zeros)."""
    n = len(text)
    key = np.ndarray((n,), ">u8", np.concatenate([text, np.zeros(8, np.uint8)]), 0, (1,)).astype(U64)
    known = 8
    while True:
        order = np.argsort(key)
        if known >= depth:
            break
        ranks = np.empty(n, U64)
        ranks[order] = np.cumsum(np.diff(key[order], prepend=~key[order[:1]]) != 0)
        bits = n.bit_length()
        key = ranks
        for i in range(1, 64 // bits):  # as many ranks as a key has room for
            key = key << U64(bits)
            key[: max(n - i * known, 0)] |= ranks[i * known :]
        known *= 64 // bits
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    return order, inverse


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """The number of each row's run of equal rows."""
    new = np.zeros(len(columns[0]), bool)
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new, dtype=np.int32)


def repeated_windows(text: np.ndarray, start: np.ndarray, end: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(interval, position) of all windows of min_bytes within the segments [start, end) of the text that occur more than once."""
    suffixes, inverse = (x.astype(np.int32) for x in sorted_suffixes(text, min_bytes))
    begin, until = (np.repeat(x.astype(np.int32), end - start) for x in (start, end))
    half = STRIDE // 2
    word = np.ndarray((len(text) + half,), "<u8", np.concatenate([text, np.zeros(STRIDE, np.uint8)]), 0, (1,)).copy()

    first = min_bytes % STRIDE or STRIDE  # the first level's prefix length, so that the last level's is min_bytes
    at = suffixes[suffixes + first <= until[suffixes]]
    head = [word[at + i] & (~U64(0) >> U64(8 * (half - k))) for i, k in ((0, min(first, half)), (half, first - half)) if k > 0]
    interval = _numbered(*head)
    length = first
    slot = np.full(len(text), -1, np.int32)
    while True:
        if len(at):  # intervals of one suffix are dropped
            many = np.zeros(len(at), bool)
            many[1:] = interval[1:] == interval[:-1]
            many[:-1] |= many[1:]
            at, interval = at[many], interval[many]
        if length >= min_bytes or not len(at):
            return interval.astype(np.int64), at.astype(np.int64)
        inside = at - STRIDE >= begin[at]
        at, interval = at[inside] - STRIDE, interval[inside]
        row = inverse[at]  # the suffix's row STRIDE bytes back; what the transform holds there are the bytes from at
        slot[row] = np.arange(len(at), dtype=np.int32)
        order = slot[np.sort(row)] if len(at) * 20 < len(slot) else slot[slot >= 0]
        slot[row] = -1
        at, interval = at[order], interval[order]
        interval = _numbered(interval, word[at], word[at + half])
        length += STRIDE


#: What the n of a part says: a segment to be sorted, a window to be settled by its digest; else the number of known repeats.
_SEGMENT, _WINDOW = 0, -1


def _dealt(batch: pa.RecordBatch, row: np.ndarray, start: np.ndarray, digests: list[bytes]) -> pa.RecordBatch:
    """Parts of windows (row in the batch of id and u, start, digest). Where a window occurs again here, only its first
    occurrence has to be settled; the others are known to be repeats, and runs of them are one part with an anchor of its own."""
    ids, u = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    order = np.empty(len(ids), np.int64)
    order[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, u[i]))] = np.arange(len(ids))
    kinds: dict[bytes, int] = {}
    kind = np.array([kinds.setdefault(d, len(kinds)) for d in digests], np.int64)
    by = np.lexsort((start, order[row], kind))
    again = np.zeros(len(by), bool)
    again[by[1:]] = kind[by[1:]] == kind[by[:-1]]
    new = np.flatnonzero(~again)
    known = np.flatnonzero(again)
    known = known[np.lexsort((start[known], row[known]))]
    head = np.flatnonzero((np.diff(start[known], prepend=-2) != 1) | (np.diff(row[known], prepend=-1) != 0))
    n = np.concatenate([np.full(len(new), _WINDOW), np.diff(np.append(head, len(known)))])
    at = np.concatenate([new, known[head]])
    own = mix(mix(start[at].astype(U64)) + order[row[at]].astype(U64)).view(np.int64)
    anchor = [int.from_bytes(digests[i][:8], "little", signed=True) if k == _WINDOW else x for i, k, x in zip(at.tolist(), n.tolist(), own.tolist(), strict=True)]
    bytes_ = [digests[i] if k == _WINDOW else b"" for i, k in zip(at.tolist(), n.tolist(), strict=True)]
    of = pa.array(row[at])
    return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), batch.column(0).take(of), batch.column(1).take(of), pa.array(start[at]), pa.array(bytes_, pa.binary()), pa.array(n, pa.int64())], names=["anchor", "id", "u", "start", "bytes", "n"])


def _decided(parts: DataFrame, min_bytes: int) -> DataFrame:
    """id, u and place of the repeated windows of parts (anchor, id, u, start, bytes, n) that aren't the first of their kind."""
    id_type = parts.schema["id"].dataType.simpleString()

    def decide(rows: pa.Table) -> pa.RecordBatch:
        same = np.all([np.diff(rows.column(c).to_numpy()) == 0 for c in ("anchor", "u", "start")], axis=0)
        if same.any():  # rows are in order, so those of identical documents stand together
            ids = rows.column("id").to_pylist()
            rows = rows.take(pa.array([0, *(i + 1 for i, x in enumerate(same) if not x or ids[i] != ids[i + 1])]))
        pieces = rows.column("bytes").to_pylist()
        end = np.cumsum([len(p) for p in pieces])
        start = end - [len(p) for p in pieces]
        interval, at = repeated_windows(np.frombuffer(b"".join(pieces), np.uint8), start, end, min_bytes)
        row = np.searchsorted(end, at, side="right")
        by = np.sort(interval << 32 | at)
        later = np.diff(by >> 32, prepend=-1) == 0  # rows are in the order of documents, so the first one is the earliest
        at = np.sort(by[later] & ((1 << 32) - 1))
        row = np.searchsorted(end, at, side="right")
        head = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(row, prepend=-1) != 0))
        count = np.diff(np.append(head, len(at)))
        row, at = row[head], at[head]
        low = rows.column("start").to_numpy()[row] + at - start[row]
        ids, u = (rows.column(c).combine_chunks().take(pa.array(row)) for c in ("id", "u"))
        return pa.RecordBatch.from_arrays([ids, u, pa.array(low << SHIFT | count)], names=["id", "u", "place"])

    first: dict[bytes, tuple] = {}  # of the anchor that is being read: the first place of each digest

    def settle(rows: pa.RecordBatch, last: int | None) -> pa.RecordBatch:
        n, anchor, start = (rows.column(c).to_numpy() for c in ("n", "anchor", "start"))
        again = n > 0
        columns = (rows.column(c).to_pylist() for c in ("anchor", "bytes", "id", "u", "start"))
        for i, (of, digest, *place) in enumerate(zip(*columns, strict=True)):
            if n[i] == _WINDOW:
                if of != last:
                    first.clear()
                    last = of
                again[i] = first.setdefault(digest, place) != place  # an identical document has the same place
        found = rows.filter(pa.array(again))
        return pa.RecordBatch.from_arrays([found.column("id"), found.column("u"), pa.array(start[again] << SHIFT | np.maximum(n[again], 1))], names=["id", "u", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last, window = 0, None, None
        for batch in arrow_batches(batches):
            n = batch.column(5).to_numpy()
            if n.any():
                yield settle(batch, window)
                windows = batch.column(0).to_numpy()[n == _WINDOW]
                window = int(windows[-1]) if len(windows) else window
                batch = batch.filter(pa.array(n == _SEGMENT))
            anchor = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(anchor)) + 1
            sizes = np.cumsum([len(p) for p in batch.column(4).to_pylist()])
            begin = 0
            if held and len(anchor) and anchor[0] != last and size >= SORT_BYTES:
                yield decide(pa.Table.from_batches(held))
                held, size = [], 0
            for cut in cuts:  # a batch is only cut between anchors
                own = int(sizes[cut - 1] - (sizes[begin - 1] if begin else 0))
                if size + own >= SORT_BYTES:
                    yield decide(pa.Table.from_batches([*held, batch.slice(begin, cut - begin)]))
                    held, size, begin = [], 0, int(cut)
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
                size += int(sizes[-1] - (sizes[begin - 1] if begin else 0))
                last = anchor[-1]
        if held:
            yield decide(pa.Table.from_batches(held))

    ordered = parts.repartition("anchor").sortWithinPartitions("anchor", F.asc_nulls_first("id"), "u", "start")
    return ordered.select("anchor", "id", "u", "start", "bytes", "n").mapInArrow(run, f"id {id_type}, u int, place long")


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["u"] == right["u"])


def mark_repeats(docs: DataFrame, min_bytes: int = 100, cut_out: bool = False) -> DataFrame:
    """The rows of docs (doc_id, text and any others) with spans: array<struct<start: int, end: int>>, the bytes of the UTF-8 text to remove.

    A byte is removed if a string of min_bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the same
    document. Strings are those of the input. Null texts are empty. A null doc_id comes before all others. Rows with one
    doc_id and different texts are documents in the order of a hash of the text; identical rows are one document, each
    of which gets the same spans. A column named spans is replaced. min_bytes is below 1 << SHIFT. cut_out: the texts come without
    their spans; a character of which a byte is removed is removed as a whole.
    """
    if not 0 < min_bytes < 1 << SHIFT:
        raise ValueError(f"min_bytes must be from 1 to {(1 << SHIFT) - 1}")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    plain = plain.withColumnRenamed(f"c{names.index('doc_id')}", "id").withColumnRenamed(f"c{names.index('text')}", "text")
    plain = plain.withColumn("u", F.hash("text"))

    dealt = _places(plain, min_bytes).repartition("anchor")
    nth = F.dense_rank().over(Window.partitionBy("anchor", "s").orderBy(F.asc_nulls_first("id"), "u", "place"))
    group = Window.partitionBy("anchor")
    # identical rows, which are one document, have equal ranks
    found = dealt.withColumn("nth", nth).withColumn("shared", (F.min("s").over(group) != F.max("s").over(group)) | (F.max("nth").over(group) > 1))
    found = found.withColumn("many", F.sum((F.col("nth") <= 2).cast("int")).over(group) > GROUP)
    found = found.withColumn("again", (F.col("nth") > F.when(F.col("many"), 1).otherwise(2)) | (F.col("place") < 0)).where("again OR shared")
    found = materialise(found.select("id", "u", "again", F.when(F.col("place") < 0, F.bitwise_not("place")).otherwise(F.col("place")).alias("place"), F.when(~F.col("again"), F.col("anchor")).alias("anchor"), "many"))

    asked = found.where("NOT again").groupBy("id", "u").agg(F.collect_set(F.struct("anchor", "place", "many")).alias("asked"))
    id_type = plain.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_without_copies, arrow_batches(batches)):
            rows: list[np.ndarray] = []
            starts: list[np.ndarray] = []
            digests: list[bytes] = []
            for i, (text, asked) in enumerate(zip(utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                place = np.array([x["place"] for x in asked], np.int64)
                start, count = place >> SHIFT, place & ((1 << SHIFT) - 1)
                many = np.array([x["many"] for x in asked], bool)
                if many.any():
                    at = np.concatenate([np.arange(s, s + c) for s, c in zip(start[many].tolist(), count[many].tolist(), strict=True)])
                    rows.append(np.full(len(at), i))
                    starts.append(at)
                    digests += [hashlib.blake2b(text[s : s + min_bytes], digest_size=16).digest() for s in at.tolist()]
                    asked, start, count = [x for x in asked if not x["many"]], start[~many], count[~many]
                    if len(digests) >= _DIGESTS:
                        yield _dealt(batch, np.concatenate(rows), np.concatenate(starts), digests)
                        rows, starts, digests = [], [], []
                bytes_ = [text[s : s + c + min_bytes - 1] for s, c in zip(start.tolist(), count.tolist(), strict=True)]
                of = pa.array(np.full(len(asked), i))
                yield pa.RecordBatch.from_arrays([pa.array([x["anchor"] for x in asked], pa.int64()), batch.column(0).take(of), batch.column(1).take(of), pa.array(start), pa.array(bytes_, pa.binary()), pa.array(np.full(len(asked), _SEGMENT))], names=["anchor", "id", "u", "start", "bytes", "n"])
            if digests:
                yield _dealt(batch, np.concatenate(rows), np.concatenate(starts), digests)

    joined = plain.join(asked, _same(plain, asked)).select(plain["id"], plain["u"], "text", "asked")
    parts = joined.mapInArrow(cut, f"anchor long, id {id_type}, u int, start long, bytes binary, n long")
    places = found.where("again").select("id", "u", "place").unionByName(_decided(parts, min_bytes))
    places = materialise(places.groupBy("id", "u").agg(F.collect_set("place").alias("places")))  # so that texts aren't shuffled twice at once
    discard(found)
    rows = plain.join(places, _same(plain, places), "left").select(*(plain[c] for c in plain.columns if c != "u"), "places")

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])

    text_at = rows.columns.index("text")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in arrow_batches(batches):
            spans = []
            for places in batch.columns[-1].to_pylist():
                place = np.sort(np.array(places or [], np.int64))
                start = place >> SHIFT
                end = np.maximum.accumulate(start + (place & ((1 << SHIFT) - 1)) + min_bytes - 1) if len(place) else start
                new = np.ones(len(start), bool)
                new[1:] = start[1:] > end[:-1]
                last = np.append(new[1:], True)[: len(start)]
                spans.append([{"start": s, "end": e} for s, e in zip(start[new].tolist(), end[last].tolist(), strict=True)])
            columns = list(batch.columns[:-1])
            if cut_out:
                columns[text_at] = pa.array([without(t, s) for t, s in zip(utf8(columns[text_at]), spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=[*batch.schema.names[:-1], "spans"])

    marked = rows.mapInArrow(merge, schema)
    back = {f"c{i}": n for i, n in enumerate(names)} | {"id": "doc_id"}
    return marked.select(*(F.col(c).alias(back.get(c, c)) for c in marked.columns if back.get(c, c).lower() != "spans"), "spans").select(*(f"`{n}`" for n in names if n.lower() != "spans"), "spans")


def kept_bytes(text: bytes, spans: list[dict]) -> bytes:
    out, at = [], 0
    for span in spans:
        out.append(text[at : span["start"]])
        at = span["end"]
    return b"".join([*out, text[at:]])


def without(text: bytes, spans: list[dict]) -> str:
    return kept_bytes(text, spans).decode("utf-8", "ignore") if spans else text.decode()


def without_repeats(marked: DataFrame) -> DataFrame:
    """The columns of marked but spans, with text less its spans. A character of which a byte is removed is removed as a whole."""
    position = marked.columns.index("text")
    schema = T.StructType([f for f in marked.schema.fields if f.name != "spans"])
    spans_at = marked.columns.index("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            columns = list(batch.columns)
            spans = columns[spans_at].to_pylist()
            columns[position] = pa.array([without(t, s) for t, s in zip(utf8(columns[position]), spans, strict=True)], pa.string())
            del columns[spans_at]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return marked.mapInArrow(run, schema)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            rows = []
            for text, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                rows.append((len(text), sum(s["end"] - s["start"] for s in spans), len(spans), hashlib.sha256(kept_bytes(text, spans)).hexdigest()))
            n, removed, spans_, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, spans_)), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.select("doc_id", "text", "spans").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
