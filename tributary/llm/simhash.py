"""SimHash fingerprints of word shingles, linked through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.components import components
from tributary.llm.text import IS_SPACE, LOWER, cut, leaving_nothing, raw, slices, small_batches, word_starts

SEED, SHINGLE, HALF = 42, 3, 32
LOW = (1 << HALF) - 1
#: A bucket with more fingerprints than this isn't compared pair by pair but cut by further deletions.
LARGE_BUCKET = 1000


def simhashes(array: pa.Array) -> np.ndarray:
    """A fingerprint for each text: bit i is 1 if it is in over half the XXH64 of the shingles, repeats included."""
    offsets, data = raw(array)
    keep = ~IS_SPACE[data]
    starts = word_starts(offsets, data)
    bounds = np.searchsorted(starts, offsets)
    out = np.zeros(len(array), np.uint64)
    if not len(starts):
        return out
    ends = keep.copy()
    ends[:-1] &= ~keep[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = keep[last]
    ends = np.flatnonzero(ends)
    kept = keep.copy()  # and one separator after each word
    kept[1:] |= keep[:-1]
    place = np.cumsum(kept) - 1
    packed = LOWER[data[kept]]
    packed[IS_SPACE[packed]] = 32
    words = np.diff(bounds)
    number = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(array)), number)
    first = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number) + bounds[row]
    final = np.minimum(first + SHINGLE, bounds[row + 1]) - 1
    content, digest = packed.tobytes(), xxhash.xxh64_intdigest
    found = [digest(content[a:b], SEED) for a, b in zip(place[starts[first]].tolist(), (place[ends[final]] + 1).tolist())]
    bits = np.unpackbits(np.asarray(found, ">u8").view(np.uint8)).reshape(-1, 64)
    full = np.flatnonzero(number)
    set_bits = np.add.reduceat(bits, (np.cumsum(number) - number)[full], axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * set_bits > number[full, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a long. Null and empty texts have 0."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(simhashes(part.column("text")).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(leaving_nothing(work), "doc_id long, fp long")


def links(distinct: DataFrame, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """(a, b), a < b: all pairs among ``distinct`` (fp) that differ in one or two bits, once each.

    A fingerprint is cut into two halves. Of at most two differing bits the low half has at most one, and then
    both fingerprints have the same low half once that bit is deleted: 32 variants (low, bit) each. Otherwise both are in the low half, and
    the high halves are equal: one variant more. Pairs in one bucket are verified on the whole fingerprint; each pair is
    taken in one bucket only. In a large bucket the rest of the fingerprint is cut by deletion too: of the bits that may still
    differ, as many are deleted, and what then is equal has at most eight members.
    """
    low, high = F.col("fp").bitwiseAND(LOW), F.shiftrightunsigned("fp", HALF)
    bit = F.explode(F.sequence(F.lit(0), F.lit(HALF)))
    mask = F.expr("shiftleft(1L, bit)")
    rest = F.when(F.col("bit") < HALF, low.bitwiseAND(F.bitwise_not(mask))).otherwise(high)
    variants = distinct.select("fp", bit.alias("bit")).withColumn("key", F.shiftleft(F.col("bit").cast("long"), HALF).bitwiseOR(rest))
    sizes = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    variants = cut(variants.join(sizes, "key"))

    def verified(x: DataFrame, keys: list[str]) -> DataFrame:
        x = x.select("fp", "bit", *keys)
        pairs = x.withColumnRenamed("fp", "a").join(x.withColumnRenamed("fp", "b").drop("bit"), keys)
        both = F.col("a").bitwiseXOR(F.col("b"))
        low_bits, one = both.bitwiseAND(LOW), F.expr("shiftleft(1L, bit)")
        here = F.when(F.col("bit") == HALF, F.bit_count(low_bits) == 2).otherwise((low_bits == one) | ((low_bits == 0) & (F.col("bit") == 0)))
        return pairs.where((F.col("a") < F.col("b")) & (F.bit_count(both) <= 2) & here).select("a", "b")

    plain = verified(variants.where(F.col("n") <= large_bucket), ["key"])
    crowded = variants.where(F.col("n") > large_bucket)
    # Bits deleted from the other half: two where two may differ, else one.
    choices = [(i, j) for i in range(HALF) for j in range(i + 1, HALF)]
    two = F.array(*[F.lit((1 << i) | (1 << j)) for i, j in choices])
    single = F.array(*[F.lit(1 << i) for i in range(HALF)])
    deleted = F.explode(F.when(F.col("bit").isin(0, HALF), two).otherwise(single))
    other = F.when(F.col("bit") == HALF, low).otherwise(high)
    crowded = crowded.select("fp", "bit", "key", other.alias("other"), deleted.alias("deleted"))
    crowded = crowded.withColumn("other", F.col("other").bitwiseAND(F.bitwise_not(F.col("deleted"))))
    return plain.unionAll(verified(crowded, ["key", "deleted", "other"]).distinct())


def near_duplicates(docs: DataFrame, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    The fingerprint is 16 hex digits, 0 for null and empty texts, which link like any others. Fingerprints that differ in two bits or
    fewer link; component_id is the smallest doc_id in the fingerprints reachable, null if all of them have null ids. Rows
    that repeat an id or a text keep their rows. Other columns are not read; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    hashed = cut(fingerprints(docs))
    distinct = cut(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"), large_bucket))
    members = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = members.join(lowest, "root").select("fp", "component_id")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return hashed.join(named, "fp").select("doc_id", text.alias("fingerprint"), "component_id")
