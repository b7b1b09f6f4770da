"""Whole-text word arrays on Arrow buffers, shared by the operators of this subpackage.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Everything here works on a
chunk of texts at a time, without a Python object per word.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch where memory is short; Spark itself bounds its bytes (64 MB unless set otherwise).
TEXT_BATCH_ROWS = 500
#: Bytes of text handled at once in a task.
CHUNK_BYTES = 1 << 19
#: Rows of a few numbers each that one task takes on: rounds over small tables need few tasks and files.
ROWS_PER_TASK = 200_000
#: A broadcast is only made of at most so many 8-byte ids, after counting them.
MAX_BROADCAST_IDS = 1_000_000

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_SEED, _STEP = _rng.integers(1, 1 << 63, 2, dtype=np.int64).astype(U64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
WEIGHTS = _rng.integers(1, 1 << 63, 64, dtype=np.int64).astype(U64) | U64(1)
#: Of the 8 bytes read at a place, those that belong to a span with k bytes to go.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Bytes from which a span is hashed by xxhash; a longer one would take a round of all spans for every 8 of its bytes.
_LONG_SPAN = 256


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: 8 bytes at a time are mixed into all spans' states together.

    The state goes through a full mix at every step, so unlike with sums of powers no repetitive
    pattern makes different spans alike.
    """
    size = ends - starts
    h = _SEED + size.astype(U64) * _STEP
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8 = np.lib.stride_tricks.as_strided(padded.view("<u1")[:8].view("<u8"), (len(data) + 1,), (1,))
    todo, k = np.flatnonzero(size < _LONG_SPAN), 0
    while len(todo := todo[size[todo] > k]):
        part = at8[starts[todo] + k] & _KEPT[np.minimum(size[todo] - k, 8)]
        h[todo] = mix((h[todo] ^ part) * _STEP)
        k += 8
    raw = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size >= _LONG_SPAN).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]], seed=int(_SEED))
    return mix(h)


class Words(NamedTuple):
    """Words of a chunk of texts: byte spans, 64-bit hashes, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    ptr: np.ndarray

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of other byte spans of the chunk."""
        return hashed(self.data, starts, ends)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(at, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return raw, off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, off: np.ndarray, lower: bool = False, gaps: np.ndarray = SPACE) -> Words:
    """Runs of bytes that are not gaps, none of them over the bound of a text."""
    if lower:
        data = LOWER[data]
    n = len(data)
    solid = np.empty(n + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(gaps[data], out=solid[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    inner = solid[1:]
    first = inner[:-1] & (~solid[:-2] | edge[:-1]) if n else np.zeros(0, bool)
    last = solid[1:-1] & (~solid[2:] | edge[1:]) if n else np.zeros(0, bool)
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, hashed(data, starts, ends), np.searchsorted(starts, off))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` neighbouring hashes, over text bounds as well."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n] * WEIGHTS[0]
    for k in range(1, width):
        out = out + h[k : k + n] * WEIGHTS[k]
    return mix(out)


def rolling(h: np.ndarray):
    """Function of a width that gives the hash of each run of so many neighbouring hashes, rolled over one running sum.

    A sum of so few mixed hashes has no repetitive pattern to cancel, as one of bytes could.
    """
    up, down = (np.multiply.accumulate(np.concatenate([[U64(1)], np.full(len(h), b, U64)])) for b in (_BASE, _UNBASE))
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * up[: len(h)], out=total[1:])

    def of(width: int) -> np.ndarray:
        n = max(0, len(h) - width + 1)
        return mix((total[width : width + n] - total[:n]) * down[:n] + U64(width))

    return of


def whole(h: np.ndarray) -> np.ndarray:
    """One hash for a whole (short) sequence."""
    return mix(np.array([(h * WEIGHTS[: len(h)]).sum(dtype=U64) + U64(len(h))], U64))


def char_counts(data: np.ndarray) -> np.ndarray:
    """1 at every byte that begins a UTF-8 code point."""
    return (data & 0xC0) != 0x80


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most TEXT_BATCH_ROWS rows for what runs inside, several Python stages in a row; the session's own number comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(TEXT_BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where none is named, as in tests, a new one, but on one machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folio-checkpoint-"))
    return sc.getCheckpointDir()


def kept_safe(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def narrow(df: DataFrame) -> DataFrame:
    """kept_safe() of a table of a few numbers a row, read again in as many tasks as its rows fill."""
    kept = kept_safe(df)
    return kept.coalesce(kept.count() // ROWS_PER_TASK + 1)


def free(name: str, columns: list[str]) -> str:
    """name, with underscores before it until it is none of the columns, which Spark compares without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def pick(docs: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of docs whose key is (or, with left_anti, is not) among ids (one column, that key).

    The ids are counted first: up to MAX_BROADCAST_IDS they are broadcast (8 bytes each), beyond
    that both sides are shuffled.
    """
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, key, how)
