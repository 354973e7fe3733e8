"""Word classes, trigram counts over a whole corpus, and bounded arrays to look them up in."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.text import HashedWords, hashed_words, leaving_nothing, mixed, raw, rows_of, slices

#: Class 0 stands before a text, class 1 at its end, 2 to 257 for rare words by their last byte, then the frequent words.
BEFORE, END, FIRST_TAIL, FIRST_WORD = 0, 1, 2, 258
BITS = 20
#: Copies share the smallest of each of so many hashes of their windows of so many words.
SLOTS, SHARED_WORDS = 3, 8
ONE, TWO = (1 << BITS) - 1, (1 << 2 * BITS) - 1


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def counted(keys: np.ndarray) -> pa.RecordBatch:
    keys, n = np.unique(keys, return_counts=True)
    return pa.record_batch([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])


def passages(words: HashedWords) -> np.ndarray:
    """A number for each text that copies share, and most near copies: of the smallest hashes of its windows of SHARED_WORDS words; 0 without a window."""
    h, row = words.hashes, rows_of(words.bounds)
    out = np.zeros(len(words.bounds) - 1, np.uint64)
    n = len(h) - SHARED_WORDS + 1
    if n > 0:
        window = np.zeros(n, np.uint64)
        for i in range(SHARED_WORDS):
            window = window * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        inside = row[SHARED_WORDS - 1 :] == row[:n]
        window, row = window[inside], row[:n][inside]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        for slot in range(SLOTS if len(first) else 0):
            window = mixed(window + np.uint64(slot))
            out[row[first]] = mixed(out[row[first]] ^ np.minimum.reduceat(window, first))
    return out.view(np.int64)


def without(words: HashedWords, shared: np.ndarray | None) -> HashedWords:
    """``words`` without the texts whose passage is in ``shared``."""
    if shared is None or not len(shared):
        return words
    kept = ~np.isin(passages(words), shared)
    inside = np.repeat(kept, np.diff(words.bounds))
    return HashedWords(words.hashes[inside], words.last[inside], np.append(0, np.cumsum(np.diff(words.bounds)[kept])))


def word_counts(docs: DataFrame, shared: np.ndarray | None = None, one: DataFrame | None = None) -> DataFrame:
    """(key, last, n): how often each lower-cased word's hash occurs in ``docs`` (text), and the word's last byte. Texts whose passages are
    ``shared`` are left out; ``one`` (text) stands for them."""

    def work(batches: Iterable[pa.RecordBatch], shared: np.ndarray | None = shared) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                words = without(hashed_words(*raw(part.column("text")), lower=True), shared)
                keys, first, n = np.unique(signed(words.hashes), return_index=True, return_counts=True)
                yield pa.record_batch([pa.array(keys), pa.array(words.last[first], pa.int16()), pa.array(n, pa.int64())], ["key", "last", "n"])

    schema = "key long, last short, n long"
    counts = docs.select("text").mapInArrow(leaving_nothing(lambda x: work(x)), schema)
    if one is not None:
        counts = counts.unionAll(one.mapInArrow(leaving_nothing(lambda x: work(x, None)), schema))
    return counts.groupBy("key", "last").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of words that occur at least ``least`` times. Where ``least`` is a share of all words, their
    number has the bound 1 / share."""
    found = counts.where(F.col("n") >= least).select("key", "n").toArrow()
    keys, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in the sorted ``table``, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def classes(words, vocabulary: np.ndarray) -> np.ndarray:
    at, there = find(vocabulary, words.hashes)
    return np.where(there, at + FIRST_WORD, words.last.astype(np.int64) + FIRST_TAIL)


def trigrams(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of three classes for each word and each text's end, and the rows' bounds."""
    current = np.insert(ids, bounds[1:], END)
    bounds = bounds + np.arange(len(bounds))
    previous = np.concatenate(([BEFORE], current[:-1]))
    previous[bounds[:-1]] = BEFORE
    second = np.concatenate(([BEFORE], previous[:-1]))
    second[bounds[:-1]] = BEFORE
    return (second << 2 * BITS) | (previous << BITS) | current, bounds


def trigram_counts(docs: DataFrame, vocabulary: np.ndarray, shared: np.ndarray | None = None, one: DataFrame | None = None) -> DataFrame:
    """(key, n) for the classes' trigrams in ``docs`` (text), with ``one`` for texts whose passages are ``shared``."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, shared))

    def work(batches: Iterable[pa.RecordBatch], every: bool = False) -> Iterator[pa.RecordBatch]:
        vocabulary, shared = sent.value
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                words = without(hashed_words(*raw(part.column("text")), lower=True), None if every else shared)
                yield counted(trigrams(classes(words, vocabulary), words.bounds)[0])

    counts = docs.select("text").mapInArrow(leaving_nothing(lambda x: work(x)), "key long, n long")
    if one is not None:
        counts = counts.unionAll(one.mapInArrow(leaving_nothing(lambda x: work(x, True)), "key long, n long"))
    return counts.groupBy("key").agg(F.sum("n").alias("n"))


class HashArray(NamedTuple):
    """Values by key, as a sorted array of the keys' 64-bit hashes and an array of values beside it."""

    hashes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> HashArray:
        hashes = mixed(keys)
        order = np.argsort(hashes)
        return cls(hashes[order], np.asarray(values, np.float32)[order])

    def get(self, keys: np.ndarray, otherwise: float) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(keys), otherwise)
        at, there = find(self.hashes, mixed(keys))
        return np.where(there, self.values[at], otherwise)


class Backoff(NamedTuple):
    """Probabilities of a class after two others, in sorted hash arrays: what the two before it have kept for it, and a weight for
    what the one before it gives; there the same, and last each class's own probability."""

    vocabulary: np.ndarray
    three: HashArray
    weight_two: HashArray
    two: HashArray
    weight_one: np.ndarray
    one: np.ndarray

    def arrays(self) -> tuple:
        """The model as plain arrays, which executors can read that don't have this package."""
        return tuple(tuple(x) if isinstance(x, HashArray) else x for x in self)

    @classmethod
    def of(cls, arrays: tuple) -> Backoff:
        return cls(*(HashArray(*x) if isinstance(x, tuple) else x for x in arrays))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        p = self.two.get(keys & TWO, 0.0) + self.weight_one[(keys >> BITS) & ONE] * self.one[keys & ONE]
        return np.log10(self.three.get(keys, 0.0) + self.weight_two.get(keys >> BITS, 1.0) * p)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
