"""Removal of repeated passages: a content-defined parse, whose phrases are put into corpus order a trigger at a time.

A rolling hash picks the trigger of every window of WINDOW bytes: the gram of GRAM bytes in it with the smallest hash. The windows with one trigger
are consecutive; the bytes they cover are a phrase. Equal windows have equal triggers at equal places, so they are in
phrases with the same trigger gram, and only phrases whose trigger occurs twice need to be looked at. For each trigger, the suffixes of its
distinct phrases, as far as a window reaches, are sorted together with the places of the phrases in the corpus; of
those that are equal over a window all but the first in corpus order are repeats.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.grams import drop_folder, signed
from tributary.llm.text import BASE, BYTE_CODES, binary, cut, give_back, mixed, powers, range_hashes, raw, small_batches
from tributary.sources.folders import shared_folder

WINDOW, GRAM = 100, 32
#: Text in a group, about; a group is worked on at once.
UNIT_BYTES = 1 << 20
#: A trigger with more occurrences sends windows instead of phrases, each to where its own copies go.
HOT = 5000
PHRASES, WINDOWS, SETTLED = 0, 1, 2
LAST = 9223372036854775807
ROW = "kind int, k long, first_id long, uid long, crc long, pos long, amount long, phrase binary, unit long"
FOUND = "unit long, uid long, crc long, start long, amount long"


def parse(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The triggers' hashes, and the first and last window of each, in order; windows lie inside one text."""
    n = len(data) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(BASE, len(data)), out=total[1:])
    grams = mixed((total[GRAM:] - total[:-GRAM]) * powers(pow(BASE, -1, 1 << 64), n))
    place = (1 << int(n).bit_length()) - 1
    least = (grams & np.uint64(~place & (1 << 64) - 1)) | np.arange(n, dtype=np.uint64)  # ties go to the first
    across, width = WINDOW - GRAM + 1, 1
    while 2 * width <= across and len(least) > width:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = across - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if len(least) > rest else least[:0]
    number = np.maximum(0, np.diff(offsets) - WINDOW + 1)
    windows = np.repeat(offsets[:-1] - (np.cumsum(number) - number), number) + np.arange(number.sum())
    if not len(windows):
        return np.zeros(0, np.uint64), windows, windows
    trigger = (least[windows] & np.uint64(place)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], trigger[1:] != trigger[:-1])))
    last = np.append(first[1:], len(trigger)) - 1
    return grams[trigger[first]], windows[first], windows[last]


def ordered(texts: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A group's texts in corpus order, their offsets and bytes."""
    texts = texts.sort_by([("first_id", "ascending"), ("uid", "ascending")]).combine_chunks()
    offsets, data = raw(pa.concat_arrays(texts.column("text").chunks) if texts.num_rows else pa.array([], pa.string()))
    return texts, offsets, data


def triggers(texts: pa.Table) -> pa.Table:
    """(g, unit, n): how often each trigger occurs in a group."""
    _, offsets, data = ordered(texts)
    g, n = np.unique(signed(parse(offsets, data)[0]), return_counts=True)
    give_back()
    unit = texts.column("unit")[0].as_py()
    return pa.table({"g": pa.array(g), "unit": pa.array(np.full(len(g), unit), pa.int64()), "n": pa.array(n, pa.int64())})


def repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, g, hot) for triggers that occur twice or more in the corpus, from rows (g, unit, n) sorted by g. Rows of one trigger wait
    until they are known to be hot, HOT of them at most."""
    held: list[tuple[np.ndarray, ...]] = []
    hot = None  # the last trigger whose rows don't wait any more

    def told(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        g, unit, n = (np.concatenate(x) for x in zip(*rows))
        start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        total = np.repeat(np.add.reduceat(n, start), np.diff(np.append(start, len(g))))
        if hot is not None:
            total = np.where(g == hot, HOT + 1, total)
        twice = total > 1
        return pa.record_batch([pa.array(unit[twice]), pa.array(g[twice]), pa.array(total[twice] > HOT)], ["unit", "g", "hot"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = tuple(c.to_numpy() for c in batch.columns)
        last = rows[0][-1]
        split = int(np.searchsorted(rows[0], last))  # the last trigger may go on
        if split:
            yield told([*held, tuple(x[:split] for x in rows)])
            held = []
        held.append(tuple(x[split:] for x in rows))
        if last == hot or sum(int(n[g == last].sum()) for g, _, n in held) > HOT:
            yield told(held)
            held, hot = [], last
    if held:
        yield told(held)


def phrases(texts: pa.Table, known: pa.Table) -> pa.Table:
    """Rows ROW of a group: each distinct phrase with a repeated trigger once, or each of its windows if the trigger is hot; and for
    phrases and windows that are earlier in the same group, that they are settled."""
    schema = pa.schema([("kind", pa.int32()), *[(x, pa.int64()) for x in ("k", "first_id", "uid", "crc", "pos", "amount")], ("phrase", pa.binary()), ("unit", pa.int64())])
    if not texts.num_rows or not known.num_rows:
        return schema.empty_table()
    texts, offsets, data = ordered(texts)
    g, first, last = parse(offsets, data)
    names, hot_names = known.column("g").to_numpy(), known.column("hot").to_numpy()
    order = np.argsort(names)
    names, hot_names = names[order], hot_names[order]
    at = np.minimum(np.searchsorted(names, signed(g)), len(names) - 1)
    there = names[at] == signed(g)
    g, first, last, hot = g[there], first[there], last[there], hot_names[at[there]]
    kinds, keys, begins, ends = [], [], [], []
    for kind in (PHRASES, WINDOWS):
        own = hot == (kind == WINDOWS)
        a, b, key = first[own], last[own], g[own]
        if kind == WINDOWS:
            number = b - a + 1
            a = np.repeat(a - (np.cumsum(number) - number), number) + np.arange(number.sum())
            b = a
        content = range_hashes(data, a, b + WINDOW) if len(a) else np.zeros(0, np.uint64)
        new = np.zeros(len(a), bool)
        new[np.unique(content, return_index=True)[1]] = True
        kinds.append(np.where(new, kind, SETTLED))
        # What is settled meets nobody: its rows go anywhere.
        keys.append(np.where(new, content if kind == WINDOWS else key, mixed(content ^ mixed(a))))
        begins.append(a)
        ends.append(b)
    kind, key, a, b = (np.concatenate(x) for x in (kinds, keys, begins, ends))
    row = np.searchsorted(offsets, a, "right") - 1
    sent = kind == PHRASES
    size = np.where(sent, b - a + WINDOW, 0)
    bounds = np.concatenate(([0], np.cumsum(size)))
    index = np.repeat(a - bounds[:-1], size) + np.arange(bounds[-1])
    columns = [pa.array(kind, pa.int32()), pa.array(signed(key)), *[pa.array(texts.column(x).to_numpy()[row], pa.int64()) for x in ("first_id", "uid", "crc")]]
    columns += [pa.array(a - offsets[row]), pa.array(b - a + 1), binary(bounds, data[index]), pa.array(texts.column("unit").to_numpy()[row], pa.int64())]
    give_back()
    return pa.Table.from_arrays(columns, schema=schema)


def repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, uid, crc, start, amount): runs of repeated windows, from rows ROW sorted by kind, k and corpus order. The phrases of one trigger
    wait for each other, HOT of them at most; other rows need the one before them only."""
    before = (PHRASES, 0)

    def told(rows: pa.Table) -> pa.RecordBatch:
        kind, key = rows.column("kind").to_numpy(), rows.column("k").to_numpy()
        pos, amount = rows.column("pos").to_numpy(), rows.column("amount").to_numpy()
        whole = kind == SETTLED
        whole[1:] |= (kind[1:] == WINDOWS) & (kind[:-1] == WINDOWS) & (key[1:] == key[:-1])
        whole[0] |= kind[0] == WINDOWS and before == (WINDOWS, key[0])
        source, start, number = [np.flatnonzero(whole)], [pos[whole]], [amount[whole]]
        some = np.flatnonzero(kind == PHRASES)
        if len(some):
            offsets, data = raw(pa.concat_arrays(rows.column("phrase").chunks).take(pa.array(some)).cast(pa.binary()))
            count = amount[some]
            bounds = np.concatenate(([0], np.cumsum(count)))
            owner = np.repeat(np.arange(len(some)), count)
            nth = np.arange(bounds[-1]) - bounds[owner]
            at = offsets[owner] + nth
            # Suffixes, as far as a window reaches, beside the trigger; equal ones in corpus order.
            suffix = mixed(range_hashes(data, at, at + WINDOW) ^ mixed(key[some].view(np.uint64))[owner])
            order = np.argsort(suffix, kind="stable")
            again = np.zeros(len(suffix), bool)
            again[order[1:]] = suffix[order[1:]] == suffix[order[:-1]]
            fresh = again.copy()
            fresh[1:] &= ~again[:-1] | (owner[1:] != owner[:-1])
            runs = np.flatnonzero(fresh)
            run_of = np.cumsum(fresh)[again] - 1
            source.append(some[owner[runs]])
            start.append(pos[some[owner[runs]]] + nth[runs])
            number.append(np.bincount(run_of, minlength=len(runs)) if len(runs) else runs)
        source = np.concatenate(source)
        columns = [pa.array(rows.column(x).to_numpy()[source], pa.int64()) for x in ("unit", "uid", "crc")]
        return pa.record_batch([*columns, pa.array(np.concatenate(start), pa.int64()), pa.array(np.concatenate(number), pa.int64())], ["unit", "uid", "crc", "start", "amount"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 4000):
            part = batch.slice(at, 4000)
            kind, key = part.column("kind").to_numpy(), part.column("k").to_numpy()
            goes_on = (kind == PHRASES) & (kind[-1] == PHRASES) & (key == key[-1])
            split = int(np.argmax(goes_on)) if goes_on[-1] else len(kind)
            if split or (held and held[-1].column("k")[-1].as_py() != key[0]):
                yield told(pa.Table.from_batches([*held, part.slice(0, split)]))
                held = []
            if split:
                before = (kind[split - 1], key[split - 1])
            if split < len(kind):
                held.append(part.slice(split))
    if held:
        yield told(pa.Table.from_batches(held))


def kept(texts: pa.Table, found: pa.Table) -> pa.Table:
    """What is left of each text of a group."""
    out: list[tuple] = []
    runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for uid, crc, start, amount in zip(*(found.column(x).to_pylist() for x in ("uid", "crc", "start", "amount"))):
        runs.setdefault((uid, crc), []).append((start, start + amount - 1 + WINDOW))
    for uid, crc, text in zip(texts.column("uid").to_pylist(), texts.column("crc").to_pylist(), texts.column("text").to_pylist()):
        data = text.encode()
        pieces, end, removed, spans = [], 0, 0, 0
        for a, b in sorted(runs.get((uid, crc), ())):
            if a > end or not spans:
                pieces.append(data[end:a])
                spans += 1
            removed += max(0, b - max(a, end))
            end = max(end, b)
        pieces.append(data[end:])
        out.append((uid, crc, len(data), removed, spans, hashlib.sha256(b"".join(pieces)).hexdigest()))
    types = [pa.int64()] * 5 + [pa.string()]
    return pa.table({n: pa.array(x, t) for n, x, t in zip(("uid", "crc", "n_bytes", "n_removed", "n_spans", "kept_sha256"), zip(*out) if out else [()] * 6, types)})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs`` (doc_id, text), null texts empty.

    A byte goes if a string of WINDOW bytes that covers it also starts earlier: in a row with a smaller id, null ids last, or earlier in the same text. Rows with one
    id are ordered by a hash of their texts. Of rows with one text the first stands for all; in the others everything goes, if they have
    WINDOW bytes. Strings are compared by 64-bit hashes beside their trigger's. Distinct texts are written once, as a table bucketed by groups in the
    shared folder; it is dropped at the end. A trigger or window, however frequent,
    is one row for each group. Other columns are not read; an empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    content = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content.alias("text"))
    rows = rows.withColumn("uid", F.xxhash64("text")).withColumn("crc", F.crc32(F.col("text").cast("binary")))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    units = -(-size // UNIT_BYTES) or 1
    buckets = min(units, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("unit", F.pmod("uid", F.lit(units)))
    texts = rows.groupBy("unit", "uid", "crc").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("first_id"), F.first("text").alias("text"))
    name = f"tributary_texts_{uuid.uuid4().hex}"
    folder = shared_folder(spark, "texts")
    texts.write.bucketBy(buckets, "unit").option("compression", "zstd").option("path", f"{folder}/{name}").saveAsTable(name)
    try:
        table = spark.table(name)
        occurring = table.groupBy("unit").applyInArrow(triggers, "g long, unit long, n long")
        known = occurring.repartition(buckets, "g").sortWithinPartitions("g").mapInArrow(repeated, "unit long, g long, hot boolean")
        sent = table.groupBy("unit").cogroup(known.groupBy("unit")).applyInArrow(phrases, ROW)
        found = sent.repartition(buckets, "k").sortWithinPartitions("kind", "k", "first_id", "uid", "pos").mapInArrow(repeats, FOUND)
        left = cut(table.groupBy("unit").cogroup(found.groupBy("unit")).applyInArrow(kept, "uid long, crc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
        firsts = cut(table.select("uid", "crc", "first_id"))
    finally:
        spark.sql(f"DROP TABLE {name}")
        drop_folder(spark, folder)
    every = rows.groupBy("uid", "crc", "doc_id").agg(F.count("*").alias("copies"))
    every = every.join(left.join(firsts, ["uid", "crc"]), ["uid", "crc"]).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    copy = ((F.col("nth") > 1) | (F.coalesce("doc_id", F.lit(LAST)) != F.col("first_id"))) & (F.col("n_bytes") >= WINDOW)
    return every.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
