"""Arrow text columns as numpy arrays, and other helpers the operators share."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tributary.sources.folders import shared_folder

#: What separates words, as bytes: space, and tab to carriage return.
SPACES = bytes([9, 10, 11, 12, 13, 32])
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text that is worked on at once, unless one document is longer.
SLICE_BYTES = 2 << 20
#: Powers of one base that are kept one by one; others are products of two.
KEPT_POWERS = 1 << 16


class Words(NamedTuple):
    """The words of a batch: word i is ``values[codes[i]]``; row r has the words ``bounds[r]:bounds[r + 1]``."""

    codes: np.ndarray
    values: pa.Array
    bounds: np.ndarray


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once into the cluster's shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Rows that go to Python at once: texts are long, and a batch is held on both sides."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        have = spark.conf.get(key, None)
        if have is not None and (not have.isdigit() or int(have) > most):
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return freed memory to the system, so that a worker that stays doesn't keep the most it ever used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def leaving_nothing(work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, after which the worker returns what the last rows took: it waits for other stages' tasks, beside other workers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def memo(name: str) -> dict:
    """A dictionary that stays with this Python worker from task to task."""
    holder = sys.modules.setdefault("_tributary_llm_memo", types.ModuleType("_tributary_llm_memo"))
    return holder.__dict__.setdefault(name, {})


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts have about ``limit`` bytes, null texts made empty."""
    at = batch.schema.get_field_index(text)
    column = pc.fill_null(batch.column(at).cast(pa.string()), "")
    batch = batch.set_column(at, pa.field(text, pa.string()), column)
    size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(size):
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + limit, "right")))
        yield batch.slice(start, end - start)
        start = end
    give_back()


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets, from 0, and the bytes of a text column without nulls."""
    if not len(array):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def coded(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the distinct values, and these."""
    encoded = array.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def in_words(data: np.ndarray) -> np.ndarray:
    """``~IS_SPACE[data]``, by comparisons, which are several times faster."""
    return (data != 32) & ((data - np.uint8(9)) > 4)


def word_starts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where words begin; a row's end also ends its last word."""
    keep = in_words(data)
    start = keep.copy()
    start[1:] &= ~keep[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = keep[first]
    return np.flatnonzero(start)


def words_of(array: pa.Array, lower: bool = False) -> Words:
    """The words of a text column without nulls."""
    offsets, data = raw(array)
    starts = word_starts(offsets, data)
    keep = ~IS_SPACE[data]
    packed = LOWER[data[keep]] if lower else data[keep]
    before = np.cumsum(keep, dtype=np.int64)
    codes, values = coded(binary(np.append(before[starts] - 1, len(packed)) if len(starts) else np.zeros(1), packed))
    return Words(codes, values, np.searchsorted(starts, offsets))


def hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each value."""
    return np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in values.to_pylist()), np.uint64, len(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each row's values."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each value."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


#: Of a polynomial hash over randomly coded bytes, modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BYTE_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64, endpoint=False) * np.uint64(2) + np.uint64(1)


def steps(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** 0 .. KEPT_POWERS - 1``, and as many powers of ``base ** KEPT_POWERS`` as reach ``count`` or more."""
    held = memo("powers")
    short, long = held.get(base, (None, ()))
    if short is None or len(long) * KEPT_POWERS < count:
        short, long = (np.full(n, x, np.uint64) for n, x in ((KEPT_POWERS, base), (max(64, -(-count // KEPT_POWERS)), pow(base, KEPT_POWERS, 1 << 64))))
        short[0] = long[0] = 1
        held[base] = short, long = np.cumprod(short, dtype=np.uint64), np.cumprod(long, dtype=np.uint64)
    return short, long


def powers(base: int, count: int) -> np.ndarray:
    """``base ** 0 .. count - 1``."""
    short, long = steps(base, count)
    return (long[: -(-count // KEPT_POWERS), None] * short).ravel()[:count]


def powers_at(base: int, at: np.ndarray) -> np.ndarray:
    """``base ** at``."""
    short, long = steps(base, int(at.max(initial=0)) + 1)
    return long[at // KEPT_POWERS] * short[at % KEPT_POWERS]


class HashedWords(NamedTuple):
    """A 64-bit hash and the last byte of each word; row r has the words ``bounds[r]:bounds[r + 1]``."""

    hashes: np.ndarray
    last: np.ndarray
    bounds: np.ndarray


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each ``data[start:end]`` that depends on its bytes only."""
    short, long = steps(BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    for i, a in enumerate(range(0, len(data), KEPT_POWERS)):
        part = BYTE_CODES[data[a : a + KEPT_POWERS]]
        part *= short[: len(part)]
        np.multiply(part, long[i], out=total[a + 1 : a + 1 + len(part)])
    np.cumsum(total[1:], out=total[1:])
    inverse = pow(BASE, -1, 1 << 64)
    found = (total[ends] - total[starts]) * powers_at(inverse, starts)
    return mixed(found ^ (ends - starts).astype(np.uint64))


def hashed_words(offsets: np.ndarray, data: np.ndarray, lower: bool = False) -> HashedWords:
    starts = word_starts(offsets, data)
    keep = in_words(data)
    packed = data[keep]
    if lower:  # as LOWER does
        packed += ((packed - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5)
    if not len(starts):
        return HashedWords(np.zeros(0, np.uint64), packed, np.zeros(len(offsets), np.int64))
    begins = np.cumsum(keep, dtype=np.int32)[starts].astype(np.int64) - 1
    ends = np.append(begins[1:], len(packed))
    return HashedWords(range_hashes(packed, begins, ends), packed[ends - 1], np.searchsorted(starts, offsets))
