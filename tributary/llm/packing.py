"""Best-fit packing of documents into token sequences, planned on the histogram of their lengths."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.grams import find
from tributary.llm.text import IS_SPACE, LOWER, binary, coded, cut, leaving_nothing, memo, range_hashes, raw, slices, small_batches
from tributary.llm.token_counts import CLOSING, LETTER, load

#: Distinct pieces of text whose ids one Python worker remembers, text that is encoded at once, and pieces the library is given at once, whose
#: results take some hundred times the memory of their ids.
REMEMBERED, ENCODED_BYTES, GIVEN = 1 << 20, 1 << 20, 1 << 12
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, `offset` long"


class Encoder:
    """Token ids of whole texts by a file of the ``tokenizers`` library, special tokens not added.

    For a file that drops white space, lower-cases and ends its words at every change from letters to marks,
    texts are cut there and each distinct piece is encoded once and remembered. Texts of any other file are encoded whole.
    """

    def __init__(self, definition: str, digest: str) -> None:
        from tokenizers import Tokenizer

        held = memo(f"ids-{digest}")
        if "tokenizer" not in held:
            held |= {"tokenizer": Tokenizer.from_str(definition), "pool": np.zeros(1 << 16, np.uint32), "used": 0, "cuts": cuts(json.loads(definition))}
            held |= {"hashes": np.zeros(0, np.uint64), "places": np.zeros((0, 2), np.int64)}
            held["tokenizer"].no_truncation()
            held["tokenizer"].no_padding()
        self.held, self.tokenizer = held, held["tokenizer"]

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each row's bounds."""
        if not self.held["cuts"]:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(array.to_pylist(), add_special_tokens=False)]
            ends = np.cumsum([0, *map(len, found)])
            return np.fromiter((x for ids in found for x in ids), np.uint32, ends[-1]), ends
        offsets, data = raw(array)
        if b"<|" not in data.tobytes():
            data = LOWER[data]
        keep = ~IS_SPACE[data]
        begins = keep.copy()
        begins[1:] &= ~keep[:-1] | (LETTER[data[:-1]] & CLOSING[data[1:]])
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[first] = keep[first]
        at, before = np.flatnonzero(begins), np.cumsum(keep)
        packed = data[keep]
        codes, values = coded(binary(np.append(before[at] - 1, len(packed)) if len(at) else np.zeros(1), packed))
        places = self.places(values)
        sizes = places[codes, 1] if len(codes) else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        index = np.repeat(places[codes, 0] - ends[:-1], sizes) + np.arange(ends[-1]) if len(codes) else codes
        return self.pool[index], ends[np.searchsorted(at, offsets)]

    def places(self, values: pa.Array) -> np.ndarray:
        """Start and size in the pool of each distinct piece's ids. Pieces are known by their hashes, in a sorted array; past REMEMBERED, new ones stay for one call only."""
        offsets, data = raw(values)
        hashes = range_hashes(data, offsets[:-1], offsets[1:])
        at, there = find(self.held["hashes"], hashes)
        found = np.zeros((len(values), 2), np.int64)
        found[there] = self.held["places"][at[there]]
        new = np.flatnonzero(~there)
        sizes, ids = np.zeros(len(new), np.int64), [np.zeros(0, np.uint32)]
        for a in range(0, len(new), GIVEN):
            some = values.take(pa.array(new[a : a + GIVEN])).cast(pa.string()).to_pylist()
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes[a : a + GIVEN] = [*map(len, encoded)]
            ids.append(np.fromiter(chain.from_iterable(encoded), np.uint32))
        used, total = self.held["used"], int(sizes.sum())
        if used + total > len(self.held["pool"]):
            self.held["pool"] = np.concatenate((self.held["pool"][:used], np.zeros(used + 2 * total, np.uint32)))
        self.pool = self.held["pool"]
        self.pool[used : used + total] = np.concatenate(ids)
        found[new] = np.column_stack((used + np.cumsum(sizes) - sizes, sizes))
        kept = new[: max(0, REMEMBERED - len(self.held["hashes"]))]
        if len(kept):
            self.held["used"] = used + int(sizes[: len(kept)].sum())
            every, places = np.concatenate((self.held["hashes"], hashes[kept])), np.concatenate((self.held["places"], found[kept]))
            order = np.argsort(every, kind="stable")
            self.held["hashes"], self.held["places"] = every[order], places[order]
        return found


def cuts(rules: dict) -> bool:
    """Whether texts may be cut at ASCII white space and between an ASCII letter and a closing mark."""
    normal = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", ())]
    split = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    words = split.get("type") == "Split" and split.get("invert") and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in split["pattern"].get("Regex", "")
    special = all(x["content"].startswith("<|") and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in rules.get("added_tokens", ()))
    return bool(words and special and normal == ["NFC", "Replace", "Lowercase"])


def plan(histogram: Mapping[int, int], capacity: int) -> np.ndarray:
    """Where documents go, by length and rank among those of that length.

    Rows (length, first rank, documents a sequence, first sequence, first offset), sorted: the document of rank r goes to sequence
    ``first + (r - first rank) // a_sequence``. Lengths above a third of the capacity are matched from the
    longest down, each with the longest that fits beside it. Shorter ones, from the longest down, go to the sequence with the
    smallest gap they fit, which stays the smallest until it is too small, so all sequences with one gap and
    all documents of one length are dealt with at once. A step uses up a length or moves sequences to less than half their gap: there
    are at most some dozens of rows for each possible length, whatever the number of documents.
    """
    left = {n: count for n, count in histogram.items() if count}
    used, rows, sequences = dict.fromkeys(left, 0), [], 0
    open_runs: dict[int, list[tuple[int, int, int]]] = {}  # by gap: first sequence, number, filled

    def put(length: int, count: int, each: int, first: int, filled: int) -> None:
        rows.append((length, used[length], each, first, filled))
        used[length] += count
        left[length] -= count

    def shelve(first: int, number: int, filled: int) -> None:
        if number and filled < capacity:
            open_runs.setdefault(capacity - filled, []).append((first, number, filled))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        while left[length]:
            beside = next((n for n in large if n <= min(length, capacity - length) and left[n] > (n == length)), None)
            number = left[length] if beside is None else left[length] // 2 if beside == length else min(left[length], left[beside])
            if beside == length:
                put(length, 2 * number, 2, sequences, 0)
                shelve(sequences, number, 2 * length)
            else:
                put(length, number, 1, sequences, 0)
                if beside is not None:
                    put(beside, number, 1, sequences, length)
                shelve(sequences, number, length + (beside or 0))
            sequences += number
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for gap in sorted(g for g in open_runs if g >= length):
            each = gap // length
            runs = open_runs.pop(gap)
            while runs and left[length]:
                first, number, filled = runs.pop()
                full = min(number, left[length] // each)
                if full:
                    put(length, full * each, each, first, filled)
                    shelve(first, full, filled + each * length)
                if full < number and left[length]:
                    rest = left[length]
                    put(length, rest, rest, first + full, filled)
                    shelve(first + full, 1, filled + rest * length)
                    full += 1
                if full < number:
                    runs.append((first + full, number - full, filled))
            for run in runs:
                shelve(*run)
            if not left[length]:
                break
        each = capacity // length
        full, rest = divmod(left[length], each)
        if full:
            put(length, full * each, each, sequences, 0)
            shelve(sequences, full, each * length)
            sequences += full
        if rest:
            put(length, rest, rest, sequences, 0)
            shelve(sequences, 1, rest * length)
            sequences += 1
    return np.asarray(sorted(rows), np.int64).reshape(-1, 5)


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int) -> DataFrame:
    definition, digest, _ = load(tokenizer)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(definition, digest)
        for batch in batches:
            for part in slices(batch, limit=ENCODED_BYTES):
                ids, bounds = encoder.encode(part.column("text"))
                ids = np.insert(ids, bounds[1:], end).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                number = -(-np.diff(bounds) // capacity)
                row = np.repeat(np.arange(len(part)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(bounds)[row] - start)
                whole, first = memoryview(ids).cast("B"), bounds[row] + start
                crc = [zlib.crc32(whole[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())]
                columns = [part.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(leaving_nothing(encode), PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """A row for each piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are its text's and then ``end``; a null or empty text is ``end`` alone. Only documents above
    ``capacity`` are cut. The driver sees how many pieces have each length, ``capacity`` numbers at most, and
    plans on these. A piece finds its place by its length and its rank among the pieces of that length: those in
    partitions before its own, and those before it in its own. So a length that most pieces share is ranked in parts. Rows that repeat an
    id or all of another row are documents of their own. Other columns are not read; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    pieces = cut(encode_pieces(docs, tokenizer, capacity, end)).withColumn("part", F.spark_partition_id())
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = cut(counts)
    ranges = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(ranges)

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("own", own).join(starts, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            _, first_rank, each, first, filled = table[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1].T
            nth = rank - first_rank
            columns = [pa.array(first + nth // each, pa.int64()), pa.array(filled + nth % each * length, pa.int64())]
            yield pa.record_batch([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PLACED)
