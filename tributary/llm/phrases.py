"""Frequent phrases and their scores, mined from sorted occurrence relations that grow by one word at a time."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.grams import drop_folder, signed
from tributary.llm.suffix_tree import STEP
from tributary.llm.text import LOWER, binary, coded, cut, give_back, hashes, mixed, raw, slices, small_batches
from tributary.sources.folders import shared_folder

BREAKS = np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
OUTSIDE = BREAKS.copy()
OUTSIDE[list(b" \t")] = True
#: Text behind one row of a relation, distinct keys a task holds before it sends them on, rows it sends at once, and keys in a range that is counted together.
RELATION_BYTES, HELD, SENT, RANGE = 8 << 20, 1 << 19, 100_000, 1 << 20
#: Marks take so many bits for each key, and 2 ** MOST_BITS at most.
BITS_PER_KEY, MOST_BITS = 32, 27
#: A relation's row has the occurrences of one slice of one language in the order of their places: ``pos`` holds the steps from place to place, ``codes`` the
#: occurrences' places in the lists ``words`` or ``keys``, 64-bit numbers, which from two words on have the keys of their first and last part beside them.
WORDS = "lang string, words array<string>, pos binary, codes binary"
GRAMS = "lang string, pos binary, codes binary, keys binary, first binary, last binary"


def marks_of(keys: DataFrame) -> np.ndarray:
    """A bit set for each of ``keys`` (key), and by chance for others: more of them where keys are so many that the table has its full size."""
    bits = min(MOST_BITS, max(10, (BITS_PER_KEY * keys.count()).bit_length())) - 6
    set_bits = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("at"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
    found = set_bits.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << bits, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return out


def marked(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(65 - len(marks).bit_length())).astype(np.int64)
    return (marks[at] >> (keys & np.uint64(63))) & np.uint64(1) != 0


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Places and codes of the lower-cased words, and the distinct words. Words beside each other in a piece have consecutive places, others don't."""
    offsets, data = raw(texts)
    inside = ~OUTSIDE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = inside[first]
    at = np.flatnonzero(starts)
    before = np.cumsum(inside, dtype=np.int64)
    codes, values = coded(binary(np.append(before[at] - 1, before[-1]) if len(at) else np.zeros(1), LOWER[data[inside]]))
    # A new row or a mark between two words makes a new piece.
    piece = np.cumsum(BREAKS[data], dtype=np.int64)[at] + np.searchsorted(offsets, at, "right") if len(at) else at
    return np.arange(len(at)) + np.cumsum(np.diff(piece, prepend=0) > 0), codes, values


def binary_of(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


def packed(pos: np.ndarray, codes: np.ndarray) -> list[pa.Array]:
    """Places as steps, in as few bytes as hold them, and codes with all lowest bytes first: both for the file's compression."""
    steps = np.diff(pos, prepend=0)
    return [binary_of(steps.astype(np.min_scalar_type(int(steps.max(initial=0))))), binary_of(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)]


def rows_of_relation(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(lang, places, codes, keys) of each row."""
    for i, lang in enumerate(batch.column("lang").to_pylist()):
        codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(4, -1).T
        codes = np.ascontiguousarray(codes).view("<u4").ravel().astype(np.int64)
        steps = batch.column("pos")[i].as_py()
        pos = np.cumsum(np.frombuffer(steps, f"u{max(1, len(steps) // max(1, len(codes)))}"), dtype=np.int64)
        if "keys" in batch.schema.names:
            keys = np.frombuffer(batch.column("keys")[i].as_py(), np.uint64)
        else:
            keys = word_keys(lang, batch.column("words")[i].values)
        yield lang, pos, codes, keys


def word_keys(lang: str, words: pa.Array) -> np.ndarray:
    return mixed(hashes(words) ^ np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1)))


def word_relation(docs: DataFrame) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=RELATION_BYTES):
                for lang in part.column("lang").unique().to_pylist():
                    own = part.filter(pc.equal(part.column("lang"), lang))
                    pos, codes, values = occurrences(own.column("text"))
                    # Frequent words first.
                    order = np.argsort(-np.bincount(codes, minlength=len(values)), kind="stable")
                    place = np.empty(len(order), np.int64)
                    place[order] = np.arange(len(order))
                    words = values.cast(pa.string()).take(pa.array(order))
                    words = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
                    yield pa.record_batch([pa.array([lang]), words, *packed(pos, place[codes])], ["lang", "words", "pos", "codes"])

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").mapInArrow(work, WORDS)


def counted(relation: DataFrame, kind: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], least: int, bits: int) -> DataFrame:
    """(lang, key, n) of the keys that occur ``least`` times or more among those that ``kind`` makes of a row's (pos, codes, keys).

    A task adds up what it has and sends one row for each range of keys, 2 ** ``bits`` of them: sorted keys and counts, packed. Who gets a range adds up again.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for lang, *row in rows_of_relation(batch):
                found = kind(*row)
                for columns in tally.put(*found, lang):
                    yield from each(columns)
            give_back()
        for columns in tally.rest():
            yield from each(columns)

    def each(found: tuple[str, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        lang, *columns = found
        yield ranges(lang, columns, bits, ["n"])

    def merged(columns: list[np.ndarray]) -> list[np.ndarray]:
        keys, index = np.unique(columns[0], return_inverse=True)
        n = np.bincount(index, columns[1], len(keys)).astype(np.int64)
        return [keys[n >= least], n[n >= least]]

    sent = relation.select("lang", "pos", "codes", "keys" if "keys" in relation.columns else "words").mapInArrow(work, "lang string, bucket long, keys binary, n binary")
    return dealt(sent, merged, ["n"])


def ranges(lang: str, columns: list[np.ndarray], bits: int, names: list[str]) -> pa.RecordBatch:
    """A row for each range of the sorted keys ``columns[0]`` that has any, with the other columns' numbers in as few bytes as hold them."""
    bucket = (columns[0] >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    narrow = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) if name == "n" else c for name, c in zip(["keys", *names], columns)]
    blobs = [pa.array([c[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()) for c in narrow]
    return pa.record_batch([pa.array([lang] * (len(edges) - 1), pa.string()), pa.array(bucket[edges[:-1]]), *blobs], ["lang", "bucket", "keys", *names])


def dealt(sent: DataFrame, merged: Callable[[list[np.ndarray]], list[np.ndarray]], names: list[str]) -> DataFrame:
    """Rows of ``ranges`` brought together by language and range, and what ``merged`` makes of each range."""

    def whole(held: list[list[bytes]]) -> list[np.ndarray]:
        keys = [np.frombuffer(k, np.uint64) for k in held[0]]
        rest = [np.concatenate([np.frombuffer(x, f"u{len(x) // max(1, len(k))}").astype(np.uint64) for x, k in zip(column, keys)]) for column in held[1:]]
        return [np.concatenate(keys), *rest]

    def flat(lang: str, held: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        columns = [signed(c) for c in merged(whole(held))]
        for a in range(0, len(columns[0]), SENT):
            some = [pa.array(c[a : a + SENT]) for c in columns]
            yield pa.record_batch([pa.array([lang] * len(some[0]), pa.string()), *some], ["lang", "key", *names])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            for lang, bucket, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                if here != (lang, bucket):
                    if held:
                        yield from flat(here[0], held)
                    here, held = (lang, bucket), [[] for _ in blobs]
                for column, blob in zip(held, blobs):
                    column.append(blob)
        if held:
            yield from flat(here[0], held)

    partitions = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sent.repartition(partitions, "lang", "bucket").sortWithinPartitions("lang", "bucket")
    return rows.mapInArrow(work, ", ".join(["lang string", "key long", *[f"{n} long" for n in names]]))


def word_texts(relation: DataFrame, marks: Broadcast) -> DataFrame:
    """(key, word) of the marked words."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for lang, row in zip(batch.column("lang").to_pylist(), batch.column("words")):
                keys = word_keys(lang, row.values)
                at = np.flatnonzero(marked(marks.value, keys))
                at = np.array([i for i, key in zip(at.tolist(), keys[at].tolist()) if key not in sent], np.int64)
                if len(sent) < HELD:
                    sent.update(keys[at].tolist())
                yield pa.record_batch([pa.array(signed(keys[at])), row.values.take(pa.array(at))], ["key", "word"])

    return relation.select("lang", "words").mapInArrow(work, "key long, word string").groupBy("key").agg(F.min("word").alias("word"))


def joined(pos: np.ndarray, codes: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, keys, and keys of both parts of phrases one word longer: the sorted relation, cut to frequent phrases, is merged with itself at the next place."""
    kept = marked(marks, keys)[codes]
    pos, own = pos[kept], keys[codes[kept]]
    at = np.flatnonzero(pos[1:] == pos[:-1] + 1)
    first, last = own[at], own[at + 1]
    return pos[at], mixed(mixed(first * STEP) + last), first, last


class Tally:
    """Counts of each language's keys, added up within a task as far as they fit."""

    def __init__(self) -> None:
        self.waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def put(self, keys: np.ndarray, n: np.ndarray, lang: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Counts of distinct keys."""
        self.waiting.setdefault(lang, []).append((keys, n))
        self.size += len(keys)
        if self.size > HELD:
            for own in self.waiting:
                self.waiting[own] = [self.settled(own)]
            self.size = sum(len(own[0][0]) for own in self.waiting.values())
            if self.size > HELD // 2:
                yield from self.rest()

    def settled(self, lang: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self.waiting[lang]) == 1:
            return self.waiting[lang][0]
        keys, index = np.unique(np.concatenate([k for k, _ in self.waiting[lang]]), return_inverse=True)
        return keys, np.bincount(index, np.concatenate([n for _, n in self.waiting[lang]]), len(keys)).astype(np.int64)

    def rest(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for lang in [*self.waiting]:
            keys, n = self.settled(lang)
            del self.waiting[lang]
            order = np.argsort(keys)
            if len(keys):
                yield lang, keys[order], n[order]
        self.__init__()


def words_of_row(pos: np.ndarray, codes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys, np.bincount(codes, minlength=len(keys))


def longer_of_row(marks: Broadcast) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Phrases one word longer than a row's, both of whose parts are marked."""
    return lambda *row: np.unique(joined(*row, marks.value)[1], return_counts=True)


def longer_relation(relation: DataFrame, marks: Broadcast, frequent: Broadcast) -> DataFrame:
    """The relation of phrases one word longer, of which those marked in ``frequent`` stay."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, *row in rows_of_relation(batch):
                pos, keys, first, last = joined(*row, marks.value)
                kept = marked(frequent.value, keys)
                keys, at, codes = np.unique(keys[kept], return_index=True, return_inverse=True)
                if len(keys):
                    rest = [binary_of(x) for x in (keys, first[kept][at], last[kept][at])]
                    yield pa.record_batch([pa.array([lang]), *packed(pos[kept], codes), *rest], ["lang", "pos", "codes", "keys", "first", "last"])
            give_back()

    return relation.select("lang", "pos", "codes", "keys" if "keys" in relation.columns else "words").mapInArrow(work, GRAMS)


def parts(relation: DataFrame, bits: int) -> DataFrame:
    """(lang, key, first, last) of a relation's phrases: the keys of all words but the last, and of all but the first."""

    def distinct(columns: list[np.ndarray]) -> list[np.ndarray]:
        at = np.unique(columns[0], return_index=True)[1]
        return [c[at] for c in columns]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("lang").to_pylist(), *([np.frombuffer(x.as_py(), np.uint64) for x in batch.column(c)] for c in ("keys", "first", "last")))
            own: dict[str, list] = {}
            for lang, *columns in rows:
                own.setdefault(lang, []).append(columns)
            for lang, tables in own.items():
                yield ranges(lang, distinct([np.concatenate(c) for c in zip(*tables)]), bits, ["first", "last"])

    sent = relation.select("lang", "keys", "first", "last").mapInArrow(work, "lang string, bucket long, keys binary, first binary, last binary")
    return dealt(sent, distinct, ["first", "last"]).drop("lang")


def with_parts(frequent: DataFrame, relation: DataFrame, table: DataFrame, words: int, bits: int) -> DataFrame:
    """(lang, key, n, words, heads, tails, inside) of the ``frequent`` phrases of ``words`` words, from ``table`` of those one word shorter: the keys of their words, the counts of
    their first and last words, one more each time, and the keys of the shorter phrases in them."""
    own = frequent.join(parts(relation, bits), "key")
    head = table.select("lang", F.col("key").alias("first"), "words", F.array_append("heads", F.col("n")).alias("heads"), F.col("inside").alias("of_first"))
    tail = table.select(F.col("key").alias("last"), F.element_at("words", -1).alias("word"), F.array_append("tails", F.col("n")).alias("tails"), F.col("inside").alias("of_last"))
    own = own.join(head, "first").join(tail, "last")
    both = F.array_union(F.array_union(F.array("first", "last"), "of_first"), "of_last") if words > 2 else F.array().cast("array<long>")
    return own.select("lang", "key", "n", F.array_append("words", F.col("word")).alias("words"), "heads", "tails", both.alias("inside"))


def exact(count: str) -> Column:
    """A count as a decimal that its products fit in."""
    return F.col(count).cast("decimal(19,0)")


def scored(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` (n, heads, tails: counts of the first and the last words) with the cut of the lowest score."""
    cuts = []
    for k in range(1, words):
        left, right = F.col("heads")[k - 1], F.col("tails")[words - k - 1]
        score = F.expr(f"cast(n as decimal(19,0)) * 2000000BD div (cast(heads[{k - 1}] as decimal(19,0)) + cast(tails[{words - k - 1}] as decimal(19,0)))")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return rows.withColumn("cut", F.array_min(F.array(*cuts)))


def mine_phrases(docs: DataFrame, top: int = 2000, least: int = 30, longest: int = 4, covered: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to ``longest`` words that occur ``least`` times or more.

    Texts of ``docs`` (lang, text) are lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces, these at spaces and tabs into words. ``a``
    counts a phrase's occurrences within pieces, overlaps included; its score is the lowest of floor(2000000 * a / (l + r)) over its cuts in two, l and r counting
    the parts. Phrases inside a longer frequent phrase go if that has ``covered`` percent of their count. Ranks go by score and count from the highest,
    then by the phrase's bytes.

    The relation of word occurrences is written in the order of their places. Phrases of one more word come from merging a relation with itself where places
    follow each other; Spark groups and counts them; and the next relation keeps the occurrences of frequent ones. That semi-join is by marks, a table of bits of a
    fixed size which keeps some others by chance when there are very many: they fall at the count. Words and phrases are known by 64-bit hashes that include the language.
    Null texts are empty and a null language is ``und``; repeated rows count each; other columns are not read; an empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_folder(spark, "phrases")

    def stored(made: Callable[[], DataFrame], name: str) -> DataFrame:
        df = made()
        schema = df.schema
        df.write.option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(f"{folder}/{name}")
        # What was shuffled for it is deleted once neither Python nor the driver's JVM knows of the plan, which the second collection is told by Python's.
        del df
        gc.collect()
        for _ in range(2):
            spark.sparkContext._jvm.System.gc()
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    texts = relation = stored(lambda: word_relation(docs), "words")
    totals = texts.groupBy("lang").agg(F.sum(F.octet_length("codes") / 4).cast("long").alias("n"))
    tokens = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(8, (tokens // RANGE).bit_length())
    table = stored(lambda: counted(texts, words_of_row, least, bits), "counts-1")
    marks = spark.sparkContext.broadcast(marks_of(table.select("key")))
    table = table.select("lang", "key", "n", F.array("key").alias("words"), *[F.array().cast("array<long>").alias(c) for c in ("heads", "tails", "inside")])
    tables = []
    for words in range(2, longest + 1):
        frequent = stored(partial(lambda rows, marks: counted(rows, longer_of_row(marks), least, bits).drop("lang"), relation, marks), f"counts-{words}")
        found = spark.sparkContext.broadcast(marks_of(frequent.select("key")))
        relation = stored(partial(longer_relation, relation, marks, found), f"relation-{words}")
        marks.unpersist()  # it has served: results are in files
        marks = found
        table = stored(partial(with_parts, frequent, relation, table, words, bits), f"phrases-{words}")
        tables.append(scored(table, words))
    every = reduce(DataFrame.unionAll, tables)
    longer = every.select(F.explode("inside").alias("key"), F.col("n").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
    gone = F.coalesce(100 * exact("longer") >= covered * exact("n"), F.lit(False))
    kept = every.join(longer, "key", "left").where(~gone)
    # Ties at the last rank stay until their words are known.
    tied = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("n")))
    best = kept.withColumn("tied", tied).where(F.col("tied") <= top).select("lang", "key", "words", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")
    kept = stored(lambda: best, "best")
    each = kept.select("key", F.posexplode("words").alias("place", "word_key"))
    needed = spark.sparkContext.broadcast(marks_of(each.select(F.col("word_key").alias("key")).distinct()))
    known = word_texts(texts, needed).withColumnRenamed("key", "word_key")
    spelled = each.join(known, "word_key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("of"))
    kept = kept.join(spelled.select("key", F.array_join("of.word", " ").alias("phrase")), "key")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    result = cut(ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    drop_folder(spark, folder)
    return result


#: The same in SQL.
PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sizes AS (
  SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM words
), grams AS (
  SELECT lang, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS phrase FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE p + k - 1 <= len(w)
), counts AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM counts WHERE k > 1
), parts AS (
  SELECT u.*, f.a AS l, s.a AS r, (2000000::HUGEINT * u.a) // (f.a + s.a) AS score FROM cuts u
  JOIN counts f ON f.lang = u.lang AND f.k = u.c AND f.phrase = array_to_string(list_slice(u.w, 1, u.c), ' ')
  JOIN counts s ON s.lang = u.lang AND s.k = u.k - u.c AND s.phrase = array_to_string(list_slice(u.w, u.c + 1, u.k), ' ')
), scored AS (
  SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS longer
  FROM scored, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN inner_phrases x ON x.lang = s.lang AND x.phrase = s.phrase WHERE x.longer IS NULL OR 100::HUGEINT * x.longer < 80::HUGEINT * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000
"""
