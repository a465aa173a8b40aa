"""Best-fit packing of tokenised documents into sequences of bounded length, by minimum bin slack.

Only how many pieces there are of each length matters for a packing, and lengths are bounded, so the plan is made on the
histogram of lengths: for each bin a bitset subset-sum finds the fullest feasible combination beside the longest piece that is
left, and that combination is taken as often as the counts allow. Pieces then look up their places by their rank within their
length, which Spark computes in salted groups.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from claimlink.llm.shared import arrow_batches, materialise, text_rows

TOKENIZER = "byte_bpe_50k.json"
#: Chunks that one worker remembers, in each of two generations, and from one task to the next; longer chunks aren't remembered.
CACHE, KEPT, CACHED_CHARS, FEW = 350_000, 100_000, 32, 10_000
#: Pieces to a salt; ranks of one length are computed in as many groups as there are salts.
SALTED = 250_000
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|*$%&#()-]*)")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


class ByteLevelEncoder:
    """Ids of whole texts by the tokenizers library, little-endian unsigned 32-bit.

    The pre-tokeniser never joins what stands on both sides of a space that follows and precedes a non-space, so texts are split
    at single spaces and the library sees each distinct chunk once. Texts with other white space after a space, or with the
    string of a special token, are given to it whole; so are all texts where the file names another pre-tokeniser or a normaliser.
    """

    #: Fixed value: the pre-tokeniser of which the above is true.
    SPLITS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        stated = json.loads(self.tokenizer.to_str())
        kind = stated["pre_tokenizer"] or {}
        self.splits = stated["normalizer"] is None and stated["model"]["type"] == "BPE" and all(kind.get(k) == v for k, v in self.SPLITS.items())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split, self.model = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model
        self.shown = {ord(b): c for b, c in zip(map(chr, range(256)), map(self.byte_sign, range(256)), strict=True)}
        self.space = self.byte_sign(32)
        self.after: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def byte_sign(b: int) -> str:
        """The character that stands for a byte: itself where it shows, else the next free one from 256 on."""
        shows = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return chr(b if b in shows else 256 + sum(x not in shows for x in range(b)))

    def forget(self) -> None:
        """Workers outlive tasks, and other stages need the memory. The chunks that came first, which are the frequent ones, stay."""
        self.new, self.old = dict(islice(self.new.items(), KEPT)), {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def chunk(self, text: str) -> bytes:
        return b"".join([self.word(w) for w, _ in self.split(text)])

    def word(self, shown: str) -> bytes:
        """Ids of one word of the pre-tokeniser, in the signs that stand for its bytes."""
        ids = [t.id for t in self.model.tokenize(shown)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def signs(self, text: str) -> bytes:
        found = self.after.get(text)
        if found is None:
            found = self.word(text)
            if len(self.after) < FEW:
                self.after[text] = found
        return found

    def after_space(self, text: str) -> bytes:
        """Ids of a chunk and the space before it; empty if the space belongs to a longer run of white space."""
        plain = _PLAIN.fullmatch(text)  # what the pre-tokeniser takes as a word and the signs after it
        if not plain:
            return b"" if not text or text[0].isspace() else self.chunk(f" {text}")
        letters, signs = plain.groups()
        if signs:  # the word itself is remembered as the chunk that it is elsewhere
            found = self.new.get(letters) or self.old.get(letters)
            if found is None:
                found = self.after_space(letters)
                if len(letters) <= CACHED_CHARS:
                    self.new[letters] = found
            return found + self.signs(signs)
        return self.word(self.space + (letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.shown)))

    def encode(self, text: str) -> bytes:
        if not self.splits or any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        found = list(map(self.new.get, rest))
        if None in found:
            new, old = self.new, self.old.get
            i = -1
            for _ in range(found.count(None)):
                i = found.index(None, i + 1)
                t = rest[i]
                found[i] = f = new.get(t) or old(t) or self.after_space(t)
                if len(t) <= CACHED_CHARS:
                    new[t] = f
            if len(new) >= CACHE:
                self.old, self.new = new, {}
        return self.whole(text) if b"" in found else self.chunk(first) + b"".join(found)


@lru_cache(1)
def encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one, or pieces of the capacity of which the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised_pieces(docs: DataFrame, capacity: int, end_id: int, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: all pieces of all texts, each with end_id at the end of its text."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in arrow_batches(batches):
            rows: list[list[int]] = [[] for _ in range(5)]
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = memoryview(encode(text or "") + tail)
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for cell, value in zip(rows, (row, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        cell.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder(path).forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_rows(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to room: bounded subset-sum on a bitset."""
    reach, limit, taken = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            size = min(size, left)
            grown = (reach | reach << length * size) & limit
            if grown != reach:
                taken.append((length, size, reach))
                reach = grown
            left, size = left - size, size * 2
    total, out = reach.bit_length() - 1, {}
    for length, size, before in reversed(taken):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + size
            total -= length * size
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces of each length: (length, first rank, pieces a bin, first bin, offset), by rank within the length.

    Ranks from a row's first rank up to the next row's (of the same length) fill bins one after another.
    """
    left, rank, out, bins = {n: c for n, c in histogram.items() if c > 0}, dict.fromkeys(histogram, 0), [], 0
    while left:
        longest = max(left)
        rest = {n: c - (n == longest) for n, c in left.items() if c - (n == longest) > 0}
        combination = fullest(rest, capacity - longest)
        combination[longest] = combination.get(longest, 0) + 1
        times, offset = min(left[n] // m for n, m in combination.items()), 0
        for n, m in sorted(combination.items(), reverse=True):
            out.append((n, rank[n], m, bins, offset))
            offset, rank[n] = offset + n * m, rank[n] + m * times
            left[n] -= m * times
            if not left[n]:
                del left[n]
        bins += times
    return out


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (length up to capacity, row: a unique long) with sequence_id and offset; pieces is read more than once."""
    salts = max(64, pieces.count() // SALTED)
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    counts = materialise(short.groupBy("length", "salt").count())
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = plan(histogram, capacity)
    by_length: dict[int, list] = {}
    for n, *rest in places:
        by_length.setdefault(n, []).append(rest)
    tables = {n: np.array(rows, np.int64).T for n, rows in by_length.items()}

    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")
    starts = counts.select("length", "salt", before.alias("before"))
    ranked = short.join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, each, base, begin = tables[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                step = rank[at] - first[k]
                sequence[at] = base[k] + step // each[k]
                offset[at] = begin[k] + step % each[k] * n
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    columns = pieces.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long, offset long"])
    return ranked.select(*columns, "rank").mapInArrow(run, schema).unionByName(whole)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs (doc_id, text).

    A null or empty text is one piece that holds end_id only; repeated rows are packed as often as they are there.
    """
    pieces = tokenised_pieces(docs, capacity, end_id, path or public_tokenizers.path(TOKENIZER))
    pieces = materialise(pieces.withColumn("row", F.monotonically_increasing_id()))
    return place(pieces, capacity).drop("row")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
