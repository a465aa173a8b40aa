"""SentencePiece encoding and decoding for merge-type vocabularies.

Each unit of a text (a run of word marks and what follows up to the next mark) is encoded by a score-ordered agenda of adjacent
symbol pairs. No piece of such a vocabulary holds a mark after another character, so units are independent. The agenda's ids are
what is returned and decoded; the sentencepiece library encodes every whole text of an Arrow batch as well, as a check.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from claimlink.llm.shared import arrow_batches

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Units that one worker remembers, in each of two generations; longer units aren't remembered.
CACHE, CACHED_CHARS = 250_000, 48
#: Units above so many characters have an agenda of their own; characters of texts that are encoded together.
LONG, STEP_CHARS = 64, 1 << 19


class AgendaEncoder:
    """Ids of many units at once. In each round every unit takes the first entry off its agenda, which is ordered by score and,
    on ties, from left to right; merges it; and enters the two pairs that the merged symbol forms with its neighbours.

    Short units go through their rounds together. A long one has a heap, so that its time grows with n log n."""

    NONE = np.int64(1 << 30)

    def __init__(self, library: sentencepiece.SentencePieceProcessor) -> None:
        plain = [i for i in range(library.vocab_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        pieces = {library.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a word mark after another character: its units aren't independent")
        self.size = library.vocab_size()
        symbol = dict(pieces)  # characters that only occur within pieces are symbols too, beyond the vocabulary
        for p in pieces:
            for c in p:
                symbol.setdefault(c, len(symbol) + self.size)
        self.of_char = np.full(0x110000, -1, np.int64)
        for p, i in symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.char_of = {i: p for p, i in symbol.items() if len(p) == 1}
        scores = {s: n for n, s in enumerate(sorted({library.get_score(i) for i in plain}, reverse=True))}
        pairs = {(symbol[p[:k]] << 32 | symbol[p[k:]]): i for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[int(k)] for k in self.pairs], np.int64)
        self.rank = np.array([scores[library.get_score(int(i))] for i in self.merged], np.int64)
        self.slots = np.full(1 << 21, -1, np.int32)  # a first guess for most pairs; searched for where it is another's
        self.slots[self._slot(self.pairs)] = np.arange(len(self.pairs))
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown, self.fallback = library.unk_id(), library.is_byte(library.piece_to_id("<0x00>"))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).view(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; NONE where they don't merge."""
        keys = left << 32 | right
        at = self.slots[self._slot(keys)].astype(np.int64)
        miss = (at >= 0) & (self.pairs[at] != keys)
        if miss.any():
            found = np.searchsorted(self.pairs, keys[miss]).clip(max=len(self.pairs) - 1)
            at[miss] = np.where(self.pairs[found] == keys[miss], found, -1)
        ok = (at >= 0) & (left >= 0) & (right >= 0)
        return np.where(ok, self.rank[at], self.NONE), self.merged[at]

    def __call__(self, units: list[str]) -> list[bytes]:
        """The units' ids, little-endian unsigned 32-bit."""
        short = iter(self.together([u for u in units if len(u) <= LONG]))
        return [next(short) if len(u) <= LONG else self.alone(u) for u in units]

    def _symbols(self, text: str) -> np.ndarray:
        """Symbols of characters; those that no piece holds are negative."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return np.where(self.of_char[code] < 0, -1 - code.astype(np.int64), self.of_char[code])

    @cached_property
    def table(self) -> dict[int, tuple[int, int]]:
        """(rank, merged symbol) of pairs that merge."""
        return dict(zip(self.pairs.tolist(), zip(self.rank.tolist(), self.merged.tolist(), strict=True), strict=True))

    def alone(self, unit: str) -> bytes:
        """Ids of one unit by a heap of (rank, place). An entry whose pair is no longer there is passed over when it comes up."""
        symbols = self._symbols(unit)
        n, rank = len(symbols), self._look_up(symbols[:-1], symbols[1:])[0]
        at = np.flatnonzero(rank < self.NONE)
        agenda = (rank[at] << 32 | at).tolist()
        heapq.heapify(agenda)
        symbol, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        merged_at = self.table.get

        def pair(i: int) -> tuple[int, int] | None:
            j = after[i]
            return merged_at(symbol[i] << 32 | symbol[j]) if j < n and symbol[i] >= 0 and symbol[j] >= 0 else None

        gone = bytearray(n)
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & 0xFFFFFFFF
            found = None if gone[i] else pair(i)
            if found is None or found[0] != entry >> 32:
                continue
            j = after[i]
            symbol[i], after[i], gone[j] = found[1], after[j], 1
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (new := pair(k)):
                    heapq.heappush(agenda, new[0] << 32 | k)
        return self._ids(np.array(symbol, np.int64)[np.frombuffer(gone, np.uint8) == 0])[0].tobytes()

    def together(self, units: list[str]) -> list[bytes]:
        if not units:
            return []
        symbol, unit = self._symbols("".join(units)), np.repeat(np.arange(len(units)), [len(u) for u in units])
        rank, merged = (np.append(x, fill) for x, fill in zip(self._look_up(symbol[:-1], symbol[1:]), (self.NONE, 0), strict=True))
        rank[np.flatnonzero(np.diff(unit))] = self.NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.diff(unit, prepend=-1))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), first)
            open_ = best >> 32 < self.NONE
            at = best[open_] & 0xFFFFFFFF
            keep = np.repeat(open_, np.diff(np.append(first, len(unit))))
            if not open_.all():
                done.append((unit[~keep], symbol[~keep]))
            symbol[at] = merged[at]
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            symbol, unit, rank, merged = symbol[keep], unit[keep], rank[keep], merged[keep]
            for i in (new, new[new > 0] - 1):
                i = i[i + 1 < len(symbol)]
                rank[i], merged[i] = self._look_up(symbol[i], symbol[i + 1])
                rank[i[unit[i] != unit[i + 1]]] = self.NONE
            if len(rank):
                rank[-1] = self.NONE
        unit, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(unit, kind="stable")
        ids, size = self._ids(symbol[order])
        ends = 4 * np.cumsum(size)[np.cumsum(np.bincount(unit, minlength=len(units))) - 1]
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, and how many each has: one, but for characters outside the vocabulary."""
        size, odd = np.ones(len(symbols), np.int64), np.flatnonzero((symbols < 0) | (symbols >= self.size))
        if not len(odd):
            return symbols.astype("<u4"), size
        kinds, kind = np.unique(symbols[odd], return_inverse=True)
        plain = [self._plain(int(s)) for s in kinds]
        length = np.array([len(p) for p in plain])
        size[odd] = count = length[kind]
        out, begin = np.repeat(symbols, size), np.cumsum(size) - size
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(begin[odd], count) + within] = np.concatenate(plain)[np.repeat((np.cumsum(length) - length)[kind], count) + within]
        return out.astype("<u4"), size

    def _plain(self, symbol: int) -> list[int]:
        """A symbol outside the vocabulary as its bytes' ids."""
        if 0 <= symbol < self.size:
            return [symbol]
        char = chr(-1 - symbol) if symbol < 0 else self.char_of[symbol]
        return [self.bytes[b] for b in char.encode()] if self.fallback else [self.unknown]


def units(text: str) -> list[str]:
    """Units of a text without their first mark; a text begins with one that isn't in it. Empty texts have none."""
    if not text:
        return []
    parts = text.replace(" ", MARK).split(MARK)
    if "" not in parts:
        return parts
    out, run = [], ""
    for i, part in enumerate(parts):
        if part or i == len(parts) - 1:
            out.append(run + part)
            run = ""
        else:
            run += MARK
    return out


class Codec:
    """Encodes and decodes texts unit by unit: number of ids, ids joined by commas, decoded text, 1 where the library's ids differ."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.agenda = AgendaEncoder(self.library)
        self.shown = [str(i) for i in range(self.library.vocab_size())]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The agenda's ids of whole texts. Units that aren't remembered yet go to the agenda, each once."""
        if len(self.new) >= CACHE:
            self.old, self.new = self.new, {}
        known, split = self.new, [units(t) for t in texts]
        missing = set(chain.from_iterable(split)).difference(known)
        fresh = []
        for u in missing:
            ids = self.old.get(u)
            if ids is None:
                fresh.append(u)
            else:
                known[u] = ids
        known.update(zip(fresh, self.agenda([MARK + u for u in fresh]), strict=True))
        out = [np.frombuffer(b"".join(map(known.__getitem__, parts)), "<u4").tolist() for parts in split]
        for u in fresh:
            if len(u) > CACHED_CHARS:
                del known[u]
        return out

    def code(self, texts: list[str]) -> list[tuple[int, str, str, int]]:
        coded = self.encode(texts)
        checked = self.library.encode(texts, num_threads=1)
        return [(len(ids), ",".join(map(self.shown.__getitem__, ids)), self.library.decode(ids) if ids else "", int(ids != other)) for ids, other in zip(coded, checked, strict=True)]


def steps_of(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of up to STEP_CHARS characters together, or one text."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > STEP_CHARS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_and_decode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, with n_tokens, ids_sha256, decoded_sha256 and n_differing (1 where the library's ids of the text differ).

    Null texts are empty; an empty text has no ids and decodes to itself. One row for each row of docs.
    """
    model = path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model).code
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in arrow_batches(batches):
            parts = steps_of([t or "" for t in batch.column(0).to_pylist()])
            rows = [(n, digest(ids), digest(decoded), differs) for part in parts for n, ids, decoded, differs in code(part)]
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            made = [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", "n_differing"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_tokens long, ids_sha256 string, decoded_sha256 string, n_differing long"])
    return docs.select(docs["text"].alias("_text"), *keep).mapInArrow(run, schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
