"""What several operators of this subpackage need: materialising, byte-bounded batches and hashed words."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Text bytes that one vectorised step takes at once; numpy temporaries are about a hundred times that.
STEP_BYTES = 1 << 18

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)


def shared_folder(df: DataFrame) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master (tests) a temporary one where it is unset."""
    session = df.sparkSession
    found = session.conf.get("spark.checkpoint.dir", None) or session.sparkContext.getCheckpointDir()
    if not found:
        if not session.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="claimlink-"))
        found = session.sparkContext.getCheckpointDir()
    return found


#: Whether what a query has shuffled is deleted when the query ends; else it stays until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and a lost executor costs nothing.

    What was shuffled for it is deleted at once: the plan of a write is its own, so nothing else reads that.
    """
    out = f"{shared_folder(df).rstrip('/')}/step-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(out)
    finally:
        conf.set(CLEANUP, before)
    back = df.sparkSession.read.schema(df.schema).parquet(out)
    _FOLDERS[back] = out
    return back


#: The folder of each frame that materialise has given out.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of frames that materialise gave out, and that no frame in use is derived from."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(df))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch that goes to Python.
BATCH_ROWS = 2_000


def text_rows(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded: rows hold whole texts, and both sides keep a batch in memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def arrow_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task. After the last one the worker, which lives on for other tasks, gives back the memory that Arrow holds."""
    yield from batches
    pa.default_memory_pool().release_unused()


def steps(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit bytes together, or of one text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all (the SplitMix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A fixed pseudo-random 64-bit number for each byte.
BYTE_CODES = mix((np.arange(1, 257, dtype=U64)) * _GOLDEN)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, STEP_BYTES + 4096)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (_BASE, _BASE_INV))
        return self.up[:n], self.down[:n]


POWERS = Powers()


class Spans:
    """64-bit hashes of any substrings of a byte buffer, from prefix sums."""

    def __init__(self, buffer: np.ndarray) -> None:
        up, self._down = POWERS.upto(len(buffer) + 1)
        self._sums = np.zeros(len(buffer) + 1, U64)
        np.cumsum(BYTE_CODES[buffer] * up[:-1], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Not mixed; equal substrings have equal values wherever they stand."""
        return (self._sums[end] - self._sums[start]) * self._down[start]


#: Bytes of a word up to which its hash is made eight bytes a step for all words at once; longer ones are hashed one by one.
LONG_WORD = 1024


def word_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of a byte buffer. Every eight bytes are mixed into what the bytes before them gave, so unlike a sum of
    powers no regular words have equal hashes by construction."""
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buffer) + 1,), "<u8", padded, 0, (1,))
    size = end - start
    out = mix(size.astype(U64) + _GOLDEN)
    order = np.argsort(-size, kind="stable")
    falling = -size[order]
    for at in range(0, min(int(size.max(initial=0)), LONG_WORD), 8):
        some = order[: np.searchsorted(falling, -at)]  # words of more than so many bytes
        left = np.minimum(size[some] - at, 8).astype(U64)
        part = eight[start[some] + at] & (~U64(0) >> (U64(64) - U64(8) * left))
        out[some] = mix(out[some] ^ part) * _GOLDEN
    for k in order[: np.searchsorted(falling, -LONG_WORD)]:
        out[k] = U64(int.from_bytes(hashlib.blake2b(buffer[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little"))
    return mix(out)


def words(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of the texts: (hash, start, end in the texts joined by a newline, first word of each text and the total)."""
    texts = list(texts)
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1)))
    start, end = edge[::2], edge[1::2]
    if len(end) < len(start):
        end = np.append(end, len(buffer))
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return word_hashes(buffer, start, end), start, end, np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of one text; of the whole sequence if it is shorter; none without words."""
    k = min(n, len(hashes))
    if not k:
        return hashes
    total = np.zeros(len(hashes) - k + 1, U64)
    for i in range(k):
        total += np.roll(hashes, -i)[: len(total)] * U64(2 * i + 1) ** U64(7) * _GOLDEN
        total = mix(total)
    return total + U64(k)
