"""Columnar text blocks: the shared Arrow/NumPy layer of the operators.

A block is a few megabytes of UTF-8 text of whole documents (a longer document
is a block of its own), seen as one byte array plus document offsets.  Words,
word hashes and shingles are computed with whole-array operations, so a task
holds one block at a time whatever the size of its partition.  Nulls count as
empty texts.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK_BYTES = 4 << 20

#: Bytes that separate words: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_DEPTH = 64
_STRIP = 1 << 16
_RANDOM = np.random.default_rng(20240607)
_TABLE = _RANDOM.integers(0, 2**64, _DEPTH * 256, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def text_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (from 0, one more than rows) of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of text, or one row: (rows, bytes, offsets)."""
    for batch in batches:
        data, offsets = text_and_offsets(batch.column(batch.schema.get_field_index(text)))
        low = 0
        while low < batch.num_rows:
            high = min(batch.num_rows, max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1))
            yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            low = high


_UNUSUAL = np.zeros(256, bool)
_UNUSUAL[[*range(0x1C, 0x20), 0xC2, *range(0xCA, 0x100)]] = True
_AFTER_QUOTE = np.zeros(256, bool)
_AFTER_QUOTE[[*b"stmdrvl"]] = True


def unusual_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold more than ASCII and Latin letters up to U+024F, or what may be a contraction or a special token.

    In all others plain byte classes agree with the Unicode classes of letters, digits and white space.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(n, bool)
    odd = _UNUSUAL[data]
    this, following = data[:-1], data[1:]
    odd[:-1] |= (this == 0xC9) & (following >= 0x90) | (this == 0xC3) & ((following == 0x97) | (following == 0xB7)) | (this == ord("'")) & _AFTER_QUOTE[following] | (this == ord("<")) & (following == ord("|"))
    return np.diff(np.searchsorted(np.flatnonzero(odd), offsets)) > 0


def distinct_words(data: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct byte strings between consecutive bounds, and the number of each string's."""
    words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy()


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, cut where a document ends."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(member), bool)
    before[0], before[1:] = False, member[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(member)]
    before[cuts] = False
    after = np.empty(len(member), bool)
    after[-1], after[:-1] = False, member[1:]
    after[cuts[cuts > 0] - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every word."""
    starts, ends = runs(~IS_SPACE[data], offsets)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte string: sums of random numbers by position and byte, or BLAKE2 where longer than 64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    for low in range(0, len(starts), _STRIP):  # a strip at a time: the arrays by byte are the largest of all
        some = slice(low, low + _STRIP)
        sizes = np.minimum(ends[some] - starts[some], _DEPTH)
        first = np.cumsum(sizes) - sizes
        within = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(first, sizes).astype(np.int32)
        out[some] = np.add.reduceat(_TABLE[(within << 8) | data[np.repeat(starts[some], sizes) + within]], first)
    for i in np.flatnonzero(ends - starts > _DEPTH):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document index of each lower-cased word, and no more."""
    starts, ends, owner = words(data, offsets)
    return hashes(LOWER[data], starts, ends), owner


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Every document's set of shingle hashes, ascending within it, and the offsets of the sets.

    With fewer words than ``width`` the whole sequence is one shingle; without words the set is empty.
    """
    tokens, owner = word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(owner, minlength=n)
    first = np.cumsum(counts) - counts
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.repeat(first - (np.cumsum(made) - made), made) + np.arange(int(made.sum()))
    sizes = np.repeat(np.minimum(counts, width), made)
    out = sizes.astype(np.uint64) * _ODD[-1]
    for j in range(width):
        ok = sizes > j
        out[ok] += tokens[at[ok] + j] * _ODD[j]
    out = mixed(out)
    bounds = np.concatenate([[0], np.cumsum(made)])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    if not len(out):
        return out, bounds
    keep = np.empty(len(out), bool)
    keep[0], keep[1:] = True, out[1:] != out[:-1]
    keep[bounds[:-1][made > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(n), made)[keep], minlength=n))])


def set_hashes(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A 128-bit hash of each set."""
    raw = sets.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins and ends among ascending keys.  A bucket is a range of keys."""
    return np.searchsorted(((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers by place, so that codecs find the many zeros of the high places together."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def from_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed(keys: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as the planes of their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, np.uint64), dtype=np.uint64)


def arrow_batches(spark, rows: int = 2000, size: int = 8 << 20) -> None:
    """Bounds the session's Arrow batches by rows and bytes, unless it has smaller bounds: a batch of long texts stays small."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def bytes_read(df: DataFrame) -> int:
    """Bytes of what the plan reads, 0 where a source doesn't know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return total if total < 1 << 60 else 0


def buckets_of(df: DataFrame, times: int = 1, size: int = 8 << 20) -> int:
    """How many buckets an exchange of the rows has: one for ``size`` bytes read, or the session's shuffle partitions where these are more, some times that."""
    return times * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bytes_read(df) // size))


def trim() -> None:
    """Gives memory that freed arrays leave with the allocators back to the system: workers live on after a group."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its own house
