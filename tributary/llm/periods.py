"""Periodic runs of words, found by block convolution with exact number-theoretic transforms."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.text import mixed, raw, rows_of, slices, small_batches, words_of

#: Transforms are of numbers modulo 15 * 2**27 + 1, of which 31 is a primitive root: products fit in 64 bits, and lengths may be up to 2**27.
PRIME, ROOT, MOST_BITS = np.uint64(15 * (1 << 27) + 1), 31, 27
#: A run has so many words or more.
LEAST = 12
#: Numbers that are transformed at once, unless one block has more.
TOGETHER = 1 << 19
SCHEMA = "doc_id long, n_words long, text string, runs array<struct<start: long, length: long, period: long>>"
#: Gives the word numbers that are read in place of the texts' own: of (ids, bounds).
Reading = Callable[[list[int | None], np.ndarray], np.ndarray]


def roots(size: int, backward: bool) -> np.ndarray:
    """``w ** 0 .. size / 2 - 1`` for a root of unity ``w`` of order ``size``."""
    w = pow(ROOT, (int(PRIME) - 1) // size, int(PRIME))
    w = pow(w, -1, int(PRIME)) if backward else w
    out = np.ones(max(1, size // 2), np.uint64)
    done = 1
    while done < len(out):
        more = min(done, len(out) - done)
        out[done : done + more] = out[:more] * np.uint64(pow(w, done, int(PRIME))) % PRIME
        done += more
    return out


def transform(a: np.ndarray) -> np.ndarray:
    """The transform of each row, in an order that ``inverse`` undoes."""
    m, size = a.shape
    half = size // 2
    while half:
        pairs = a.reshape(m, -1, 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        a = np.stack(((low + high) % PRIME, (low + PRIME - high) * roots(2 * half, False) % PRIME), axis=2).reshape(m, size)
        half //= 2
    return a


def inverse(a: np.ndarray) -> np.ndarray:
    m, size = a.shape
    half = 1
    while half < size:
        pairs = a.reshape(m, -1, 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1] * roots(2 * half, True) % PRIME
        a = np.stack(((low + high) % PRIME, (low + PRIME - high) % PRIME), axis=2).reshape(m, size)
        half *= 2
    return a * np.uint64(pow(size, -1, int(PRIME))) % PRIME


def zero_mismatches(values: np.ndarray, starts: np.ndarray, block: int, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) at which each block's sum of squared differences to the text ``near`` to ``far`` words further on is zero modulo PRIME.

    The sum is that of the block's squares and of the text's, less twice their correlation, which is a product of transforms. A distance without a mismatch has the
    sum zero; others have it by a chance of one in PRIME. Behind the text stand zeros.
    """
    count = far - near + 1
    size = 1 << (count + block - 2).bit_length()
    if size > 1 << MOST_BITS:
        raise ValueError("a text is too long for transforms of 2**27 numbers")
    found = []
    each = max(1, TOGETHER // size)
    for a in range(0, len(starts), each):
        at = starts[a : a + each]
        own = values[at[:, None] + np.arange(block)]
        place = at[:, None] + np.arange(near, far + block)
        there = np.where(place < len(values), values[np.minimum(place, len(values) - 1)], np.uint64(0))
        left, right = np.zeros((len(at), size), np.uint64), np.zeros((len(at), size), np.uint64)
        left[:, :block] = own[:, ::-1]
        right[:, : there.shape[1]] = there
        correlation = inverse(transform(left) * transform(right) % PRIME)[:, block - 1 : block - 1 + count]
        running = np.concatenate((np.zeros((len(at), 1), np.uint64), np.cumsum(there * there % PRIME, axis=1)), axis=1)
        squares = (own * own % PRIME).sum(axis=1, keepdims=True) + running[:, block : block + count] - running[:, :count]
        rows, offsets = np.nonzero((squares + 2 * (PRIME - correlation)) % PRIME == 0)
        found.append((at[rows], offsets + near))
    starts, distances = zip(*found) if found else ((), ())
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *starts]).astype(np.int64), np.concatenate([empty, *distances]).astype(np.int64)


def equal_stretch(codes: np.ndarray, at: np.ndarray, other: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many of the words from ``at`` on equal those from ``other`` on, ``room`` at most, going by ``step`` (1 or -1)."""
    out, active, width = np.zeros(len(at), np.int64), np.flatnonzero(room > 0), 8
    while len(active):
        t = out[active, None] + np.arange(width)
        inside = t < room[active, None]
        t = np.where(inside, t, 0)
        same = inside & (codes[at[active, None] + step * t] == codes[other[active, None] + step * t])
        out[active] += np.where(same.all(axis=1), width, same.argmin(axis=1))
        active = active[same[:, -1] & same.all(axis=1)]
        width = min(2 * width, max(8, TOGETHER // max(1, len(active))))
    return out


def next_distance(codes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How far on each word is found again in its text; a large number if it isn't."""
    keys = row * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(keys, kind="stable")
    again = keys[order][1:] == keys[order][:-1]
    out = np.full(len(codes), 1 << 60)
    out[order[:-1][again]] = np.diff(order)[again]
    return out


def find_runs(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period), sorted by text, start and period: every stretch of words with smallest period q, ``least`` and 2 * q words or more, that no
    neighbouring word extends. Text r has the words ``codes[bounds[r]:bounds[r + 1]]``.

    Scales double: blocks of B words at multiples of B are looked for 2 * B - 1 to 4 * B - 2 words further on (from 1 word on for B = 2), so that a run with such a
    period holds a whole block and its repetition. Blocks in which a word isn't found again within that distance have none
    and aren't transformed. Neighbouring blocks with one distance are one seed, which is extended to both sides by comparing words. A stretch found for
    several periods has the smallest. Least must be 9 or more for the first scale to hold a block of each run.
    """
    n = len(codes)
    row = rows_of(bounds)
    begin, end = bounds[row], bounds[row + 1]
    values = mixed(codes.astype(np.uint64) + np.uint64(1)) % PRIME
    again = next_distance(codes, row)
    longest = int(np.diff(bounds).max(initial=0))
    found = np.zeros((0, 3), np.int64)
    covered_to, covered_by = np.zeros(n, np.int64), np.ones(n, np.int64)
    block = 2
    while longest >= least and (block == 2 or 2 * block - 1 <= longest // 2):
        near, far = 1 if block == 2 else 2 * block - 1, 4 * block - 2
        # Words found again near enough, in stretches of as many as a run has besides its last period.
        ok = again <= far
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        wide = (edge[1::2] - edge[::2]) >= max(2 * block - 1, least // 2)
        first, last = edge[::2][wide], edge[1::2][wide]
        number = np.maximum(0, last // block - -(-first // block))
        starts = (np.repeat(-(-first // block) - (np.cumsum(number) - number), number) + np.arange(number.sum())) * block
        # A block may reach into the next text, a word that is found again can't.
        starts = starts[starts + block <= end[starts]] if len(starts) else starts
        at, distance = zero_mismatches(values, starts, block, near, min(far, longest - 1))
        kept = at + distance + block <= end[at]
        kept &= ~((covered_to[at] >= at + distance + block) & (distance % covered_by[at] == 0))
        at, distance = at[kept], distance[kept]
        # The sum may be zero by chance, so the words are compared as well.
        real = equal_stretch(codes, at, at + distance, np.full(len(at), block), 1) >= block
        at, distance = at[real], distance[real]
        order = np.lexsort((at, distance))
        at, distance = at[order], distance[order]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != block) | (np.diff(distance) != 0) | (begin[at[1:]] != begin[at[:-1]])
        seeds = np.flatnonzero(new)
        until = at[np.append(seeds[1:], len(at))[: len(seeds)] - 1] + block if len(seeds) else at
        at, distance = at[seeds], distance[seeds]
        right = equal_stretch(codes, until, until + distance, end[at] - until - distance, 1)
        left = equal_stretch(codes, at - 1, at - 1 + distance, at - begin[at], -1)
        start, length = at - left, until + right + distance - at + left
        kept = (length >= least) & (length >= 2 * distance)
        own = np.unique(np.column_stack((start, length, distance))[kept], axis=0)
        for s, size, period in own[own[:, 1] >= 64].tolist():
            if covered_to[s] < s + size:
                covered_to[s : s + size], covered_by[s : s + size] = s + size, period
        found = np.concatenate((found, own))
        block *= 2
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    same = np.zeros(len(found), bool)
    same[1:] = (np.diff(found[:, 0]) == 0) & (np.diff(found[:, 1]) == 0)
    found = found[~same]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    text = row[found[:, 0]] if n else found[:, 0]
    return np.column_stack((text, found[:, 0] - bounds[text], found[:, 1], found[:, 2])) if len(found) else np.zeros((0, 4), np.int64)


def written(values: pa.Array, codes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts of the words ``values[codes]``, joined by one space."""
    offsets, data = raw(values)
    begins, sizes = offsets[codes], np.diff(offsets)[codes] + 1
    ends = np.concatenate(([0], np.cumsum(sizes)))
    index = np.repeat(begins - ends[:-1], sizes) + np.arange(ends[-1])
    out = np.append(data, np.uint8(32))[np.minimum(index, len(data))]
    out[ends[1:] - 1] = 32
    # The space behind a text's last word goes.
    closing = ends[bounds[1:][np.diff(bounds) > 0]] - 1
    kept = np.ones(len(out), bool)
    kept[closing] = False
    filled = np.concatenate(([0], np.cumsum(np.diff(bounds) > 0)))
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer((ends[bounds] - filled).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out[kept]))])


def collapse_runs(docs: DataFrame, reading: Reading | None = None, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, text, runs) for every row of ``docs`` (doc_id, text): the periodic runs of its words, by start and period, and the text without what they repeat.

    Words are what isn't white space; a run is a stretch of ``least`` words and two periods or more, as long as it goes, with its smallest period.
    The first period of each run stays; a word behind it in any run goes, and the others are joined by one space. ``reading`` may
    put other words of the same texts in the words' places first. A null or empty text has no words and no runs. Rows that repeat an id or
    a text keep their rows; other columns are not read; an empty table gives none. A text is one task's work, whatever its length.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"))
                codes, bounds = words.codes, words.bounds
                if reading is not None:
                    codes = codes[reading(part.column("doc_id").to_pylist(), bounds)]
                runs = find_runs(codes, bounds, least)
                begin = bounds[runs[:, 0]] + runs[:, 1]
                inside = np.zeros(len(codes) + 1, np.int64)
                np.add.at(inside, begin + runs[:, 3], 1)
                np.add.at(inside, begin + runs[:, 2], -1)
                kept = np.cumsum(inside)[:-1] == 0
                left = np.concatenate(([0], np.cumsum(kept)))[bounds]
                each = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(runs[:, 0], np.arange(len(part) + 1)), pa.int32()), each)
                columns = [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds)), written(words.values, codes[kept], left), lists]
                yield pa.record_batch(columns, ["doc_id", "n_words", "text", "runs"])

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)


def every_tenth_repeats(ids: list[int | None], bounds: np.ndarray) -> np.ndarray:
    """Word numbers with repetitions put in: where crc32 of the decimal id, that of the empty text for null, is a multiple of 10, the words from a place
    on are those of one period again and again. Place and period depend on the sum and the number of words."""
    h = np.fromiter((zlib.crc32(b"" if x is None else str(x).encode()) for x in ids), np.int64, len(ids))
    g, n = h // 10, np.diff(bounds)
    a = np.where(n > 0, g % np.maximum(n, 1), 0)
    p = 1 + (n - a) // (3 + g % 8)
    row = rows_of(bounds)
    i = np.arange(bounds[-1]) - bounds[row]
    a, p = a[row], p[row]
    return bounds[row] + np.where((h % 10 == 0)[row] & (i >= a), a + (i - a) % p, i)


def run_digests(collapsed: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of what ``collapse_runs`` returns, with the longest run's numbers."""
    best = F.try_element_at(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.sign(y["length"] - x["length"])).when(x["start"] != y["start"], F.sign(x["start"] - y["start"])).otherwise(F.sign(x["period"] - y["period"])).cast("int")), F.lit(1))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = collapsed.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")
