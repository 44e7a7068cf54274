"""Shared helpers of the training-data operators: bounds of batches, bitmaps and vectorised text hashing; cut points of the library.

Word hashing works on the UTF-8 bytes of whole Arrow string columns. A word's hash is a polynomial over random byte
codes modulo 2^64, taken from one prefix sum a chunk, so its cost does not depend on the number of words.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import cut, new_path  # noqa: F401

CHUNK_BYTES = 1 << 20
BITMAP_BITS, MOST_BITS = 1 << 23, 1 << 28
#: Text that one Arrow batch takes to Python; the default limit of rows alone lets long texts make batches of any size.
BATCH_BYTES = 4 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
WORD_BYTES = 1 << 18


def bound_batches(spark: SparkSession) -> None:
    """Limit the bytes of Arrow batches in this session, unless a limit lower than Spark's own is set already."""
    now = spark.conf.get(BATCH_KEY).removesuffix("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def trimmed(run: Callable) -> Callable:
    """run, a generator over batches; after each batch unused memory goes back to the system, as idle workers would keep it."""

    @functools.wraps(run)
    def out(batches: Iterator) -> Iterator:
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        for batch in run(batches):
            yield batch
            pa.default_memory_pool().release_unused()
            if trim:
                trim(0)

    return out


def remove(*tables: DataFrame) -> None:
    """Delete the files of tables that cut() has written and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bitmap_bits(keys: int) -> int:
    """A size for so many keys: 16 bits each, within fixed bounds. Past the upper one more of the rest passes the bitmap."""
    return min(MOST_BITS, max(BITMAP_BITS, 1 << (16 * keys).bit_length()))


def bitmap_of(keys: DataFrame, hash_col: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of fixed size with bit (hash mod bits) set for each row. At most bits / 64 longs reach the driver."""
    pos = F.pmod(F.col(hash_col), F.lit(bits))
    words = (
        keys.select(pos.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    )
    out = np.zeros(bits // 64, np.uint64)
    idx, val = (c.to_numpy() for c in words.toArrow().columns)
    out[idx] = val.view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """hashes: int64. Which of them may be in the bitmap (all that are, and few others)."""
    p = hashes.astype(np.int64) % np.int64(len(bitmap) * 64)
    return (bitmap[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1


_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
STEP = np.uint64(0xD6E8FEB86659FD93)
STEP_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of STEP and of its inverse modulo 2^64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, s, np.uint64)])) for s in (STEP, STEP_INV)]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX2
    return h ^ (h >> np.uint64(29))


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets of the rows) with about size bytes each; a longer row stands alone."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each row's first word (one more entry than rows)."""
    word = ~sep[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(word & (first[:-1] | np.concatenate([[True], ~word[:-1]])))
    ends = np.flatnonzero(word & (first[1:] | np.concatenate([~word[1:], [True]]))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each word's bytes. Works through WORD_BYTES at a time, so that memory does not follow the text."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + WORD_BYTES, "right")))
        part, s, e = data[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base
        up, down = powers(len(part) + 1)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(BYTE_CODES[part] * up[: len(part)], out=total[1:])
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * MIX)
        i = j
    return out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries of h (also across rows: the caller leaves those out)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, k * int(MIX) & (1 << 64) - 1, np.uint64)
    for j in range(k):
        out = out * STEP + h[j : j + m]
    return mix(out)
