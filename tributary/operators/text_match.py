"""Which texts contain, start with or end with one of many needles, or lack one of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.sizing import broadcast_limit, estimated_bytes

TESTS = {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}
#: Needles that a text is asked for before all others.
WITNESSES = 16
#: Odd numbers by byte, and those that join the halves of a piece.
CODES = np.random.default_rng(11).integers(1, 1 << 62, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits of the largest table of marks, and texts' pieces in a batch.
MOST_MARKS, PIECES = 27, 1000
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _folded(column: Column, ignore_case: bool) -> Column:
    return F.lower(column) if ignore_case else column


def _needles(needles: DataFrame, ignore_case: bool) -> DataFrame:
    return needles.select(_folded(F.col("needle"), ignore_case).alias("needle")).where(F.col("needle").isNotNull()).distinct()


def text_matches(texts: DataFrame, needles: DataFrame, op: str, ignore_case: bool = True, broadcast_bytes: int | None = None) -> DataFrame:
    """Rows of ``texts(value)``, which must be distinct, that match a needle in ``needles(needle)``.

    Needles within ``broadcast_bytes``, by default the session's broadcast bound, are compared directly. Beyond it the pairs that ``matching_pairs`` finds count.
    """
    needles = _needles(needles, ignore_case)
    limit = broadcast_limit(texts.sparkSession) if broadcast_bytes is None else broadcast_bytes
    size = estimated_bytes(needles)
    if size is not None and size <= limit:
        return texts.join(F.broadcast(needles), TESTS[op](_folded(F.col("value"), ignore_case), F.col("needle")), "left_semi")
    # Both uses of the texts read the same rows, so that whatever made them distinct is done once.
    texts = texts.where(F.col("value").isNotNull())
    pairs = candidates(texts, needles, op, ignore_case)
    keyed = texts.select("value", F.xxhash64("value").alias("key"))
    test = (F.col("t.key") == F.col("p.key")) & TESTS[op](_folded(F.col("t.value"), ignore_case), F.col("p.needle"))
    return keyed.alias("t").join(pairs.alias("p"), test, "left_semi").select("value")


def lacking(texts: DataFrame, needles: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Rows of ``texts(value)``, which must be distinct, that don't contain every needle in ``needles(needle)``.

    The WITNESSES longest needles settle nearly all texts: one that lacks any of them is in. Only for texts that contain
    them all are the needles counted that they contain, and compared with the number there is.
    """
    needles = _needles(needles, ignore_case)
    asked = needles.orderBy(F.length("needle").desc(), "needle").limit(WITNESSES).agg(F.collect_list("needle").alias("witnesses"))
    asked = asked.crossJoin(needles.agg(F.count(F.lit(1)).alias("all")))  # one row each
    told = _keyed(texts, ignore_case).crossJoin(F.broadcast(asked))
    lacks = F.exists("witnesses", lambda w: ~F.contains(F.col("folded"), w))
    at_once = told.where(lacks).select("value")
    rest = told.where(~lacks & (F.col("all") > F.size("witnesses"))).select("value", "key", "folded", "all")
    pairs = candidates(rest, needles, "contains", ignore_case)
    found = rest.alias("t").join(pairs.alias("p"), (F.col("t.key") == F.col("p.key")) & F.contains("t.folded", "p.needle"), "left")
    counted = found.groupBy("t.value", "t.all").agg(F.count("p.needle").alias("n"))
    return at_once.unionAll(counted.where(F.col("n") < F.col("all")).select("value"))


def _keyed(texts: DataFrame, ignore_case: bool) -> DataFrame:
    folded = _folded(F.col("value"), ignore_case)
    return texts.select("value", F.xxhash64("value").alias("key"), folded.alias("folded"))


def candidates(texts: DataFrame, needles: DataFrame, op: str, ignore_case: bool = True) -> DataFrame:
    """(key, needle): pairs that include all in which the text of hash ``key`` matches the folded needle.

    A needle's anchor is its first bytes, its last for ``ends_with``: as many as the largest power of two within its length; its far end is as many
    bytes at its other end, so that both together cover it. Texts give the hashes of their pieces of the needles' lengths whose anchors and whole hashes are marked, and
    are hash-joined to the needles. The texts themselves stay where they are, and so do all other pieces. Empty needles are paired with every text.
    """
    anchored = needles.where("needle <> ''").mapInArrow(_anchors(op), "needle string, size int, anchor long, hash long")
    marks = _marks(anchored)
    pieces = _keyed(texts, ignore_case).select("key", "folded").mapInArrow(_pieces(op, texts.sparkSession.sparkContext.broadcast(marks)), "key long, size int, hash long")
    found = pieces.join(anchored.select("needle", "size", "hash"), ["size", "hash"]).select("key", "needle")
    empty = _keyed(texts, ignore_case).select("key").crossJoin(F.broadcast(needles.where("needle = ''").limit(1)))
    return found.unionAll(empty).distinct()


def _marks(anchored: DataFrame) -> tuple[dict[int, list[int]], int, np.ndarray, np.ndarray]:
    """The needles' lengths by the bits of their anchors, and bits set for each anchor and each whole hash: 32 times as many bits as needles, at most 2 ** MOST_MARKS.
    With more needles, more pieces pass by chance, but none is lost."""
    sizes = sorted((r["size"], r["n"]) for r in anchored.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect())
    lengths: dict[int, list[int]] = {}
    for size, _ in sizes:
        lengths.setdefault(size.bit_length() - 1, []).append(size)
    bits = min(MOST_MARKS, max(10, (32 * sum(n for _, n in sizes)).bit_length()))
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("of"), F.shiftrightunsigned(name, 64 - bits).alias("place")) for i, name in enumerate(("anchor", "hash"))]))
    rows = anchored.select(places.alias("mark")).select("mark.of", "mark.place")
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    found = rows.groupBy("of", F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("word")).toArrow()
    marks = np.zeros((2, 1 << (bits - 6)), np.uint64)
    marks[found.column("of").to_numpy(), found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return lengths, bits, marks[0], marks[1]


def _has(marks: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - bits)
    return (marks[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _spread(hashes: np.ndarray) -> np.ndarray:
    """The sums of products, whose low bits are the better ones, with all bits mixed."""
    hashes = (hashes ^ (hashes >> np.uint64(32))) * SECOND
    return (hashes ^ (hashes >> np.uint64(29))) * FIRST


def _whole(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The hash of a needle by those of its anchor and its far end."""
    return _spread(near * FIRST + (far ^ (far >> np.uint64(31))))


def _hashes(data: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """For bits 0, 1, ... the hashes of the pieces of 2 ** bits bytes that begin at each byte."""
    found, bits = CODES[data], 0
    while bits <= most and len(found):
        yield bits, found
        half = 1 << bits
        found = found[:-half] * FIRST + (found[half:] ^ (found[half:] >> np.uint64(29))) * SECOND
        bits += 1


def _anchors(op: str):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, anchors, wholes = [], [], []
            for needle in batch.column("needle").to_pylist():
                data = np.frombuffer(needle.encode(), np.uint8)
                *_, (_, found) = _hashes(data, len(data).bit_length() - 1)
                near, far = (found[-1:], found[:1]) if op == "ends_with" else (found[:1], found[-1:])
                sizes.append(len(data))
                anchors.append(_spread(near)[0])
                wholes.append(_whole(near, far)[0])
            hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (anchors, wholes)]
            yield pa.record_batch([batch.column("needle"), pa.array(sizes, pa.int32()), *hashes], ["needle", "size", "anchor", "hash"])

    return work


def _pieces(op: str, shared):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, bits, anchors, wholes = shared.value
        for batch in batches:
            out = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("folded").to_pylist()):
                if text is None:
                    continue
                data = np.frombuffer(text.encode(), np.uint8)
                for power, found in _hashes(data, max(lengths, default=-1)):
                    if power in lengths:
                        out += [(key, size, own) for size, own in _met(op, found, power, lengths[power], bits, anchors, wholes) if len(own)]
            for a in range(0, len(out), PIECES):
                keys, sizes, own = zip(*out[a : a + PIECES])
                counts = [len(x) for x in own]
                hashes = np.concatenate(own).view(np.int64)
                columns = [np.repeat(np.array(keys, np.int64), counts), np.repeat(np.array(sizes, np.int32), counts), hashes]
                yield pa.record_batch([pa.array(x) for x in columns], ["key", "size", "hash"])

    return work


def _met(op: str, found: np.ndarray, power: int, sizes: list[int], bits: int, anchors: np.ndarray, wholes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each length, the distinct hashes of a text's pieces that may be needles. ``found`` are those of its pieces of 2 ** ``power`` bytes."""
    if op == "contains":
        at = np.flatnonzero(_has(anchors, bits, _spread(found)))
    else:
        at = np.array([0 if op == "starts_with" else len(found) - 1])
    for size in sizes:
        step = size - (1 << power)
        if op == "ends_with":
            near, far = at[at >= step], at[at >= step] - step
        else:
            near, far = at[at + step < len(found)], at[at + step < len(found)] + step
        own = _whole(found[near], found[far])
        yield size, np.unique(own[_has(wholes, bits, own)])
