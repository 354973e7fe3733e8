"""Toxicity by compression distance: which of two zstandard dictionaries, lists of words that mark each class, shortens a text's windows more."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.text import memo, slices, small_batches, words_of

#: The classifier learns from this many bytes of labelled texts of each class at most, and this many texts.
TRAIN_BYTES, TRAIN_TEXTS = 3 << 20, 3000
#: Beginnings of words, by length in bytes, that may tell the classes apart; in so many contexts, and so many times as often.
STEMS, LEAST_CONTEXTS, LEAST_RATIO = (4, 5, 6), 8, 16.0
DICTIONARY_BYTES, LEVEL = 8192, 13
#: What stands on both sides of a window, and in both dictionaries, so that its inside alone makes a difference: the compressor doesn't look for
#: matches in the last bytes of its input.
LEFT, RIGHT = bytes(range(128, 144)), bytes(range(144, 160))
MARKS = b".,;:!?\"'()"
#: Windows whose distance one Python worker remembers, and the distance from which a window counts.
REMEMBERED, COUNTS_FROM = 150_000, 3


def held_out(doc_id: str = "doc_id", parts: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == 0


def stem_contexts(texts: list[bytes]) -> tuple[Counter, dict[bytes, Counter]]:
    """In how many different surroundings each stem stands, and the words that begin with it. Surroundings, not occurrences: a passage that
    is copied often has the same each time."""
    seen: set[int] = set()
    stems: Counter = Counter()
    words: dict[bytes, Counter] = {}
    for text in texts:
        own = text.lower().split()
        for before, word, after in zip([b"", *own], own, [*own[1:], b""]):
            word = word.strip(MARKS)
            place = hash((before, word, after))
            if len(word) < STEMS[0] or place in seen:
                continue
            seen.add(place)
            for n in STEMS:
                if len(word) >= n:
                    stems[word[:n]] += 1
                    words.setdefault(word[:n], Counter())[word] += 1
    return stems, words


def segments(own: list[bytes], other: list[bytes]) -> list[bytes]:
    """What marks ``own`` texts: stems far more diverse there, or the words they nearly always are; the most frequent last."""
    stems, words = stem_contexts(own)
    others, _ = stem_contexts(other)
    scale = max(1, sum(others.values())) / max(1, sum(stems.values()))
    found: dict[bytes, int] = {}
    for stem, n in stems.items():
        if n >= LEAST_CONTEXTS and n / (others[stem] + 1) * scale >= LEAST_RATIO:
            for word in [w for w, k in words[stem].items() if k >= 0.1 * n] or [stem]:
                found[word] = max(found.get(word, 0), n)
    return [b" " + w for w in sorted(found, key=lambda w: (found[w], w))]


def dictionary(parts: list[bytes]) -> bytes:
    return b"".join(parts)[-DICTIONARY_BYTES:] + LEFT + RIGHT


class Classifier(NamedTuple):
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, float, float]


class Distance:
    """How many bytes longer a window is with the ordinary dictionary than with the toxic one."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        rules = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)

        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            return zstandard.ZstdCompressor(compression_params=rules, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

        self.toxic, self.ordinary = compressor(toxic).compress, compressor(ordinary).compress
        self.known = memo(f"distance-{hash((toxic, ordinary))}")

    def of(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            window = LEFT + b" " + word.strip(MARKS) + RIGHT
            found = len(self.ordinary(window)) - len(self.toxic(window))
            if len(self.known) < REMEMBERED:
                self.known[word] = found
        return found

    def features(self, array: pa.Array) -> np.ndarray:
        """For each text the largest distance of its windows, a word each, and the logarithm of the sum of those that count."""
        codes, values, bounds = words_of(array, lower=True)
        distance = np.fromiter(map(self.of, values.to_pylist()), np.float64, len(values))[codes] if len(codes) else np.zeros(0)
        out = np.zeros((len(array), 2))
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            out[full, 0] = np.maximum(0, np.maximum.reduceat(distance, bounds[full]))
            out[full, 1] = np.log1p(np.add.reduceat(np.where(distance >= COUNTS_FROM, distance, 0.0), bounds[full]))
        return out


def calibrated(features: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Intercept and weights of a logistic regression with a small penalty, by Newton's method."""
    x, w = np.column_stack((np.ones(len(features)), features)), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - 0.01 * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.01 * np.eye(3), slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def sample(docs: DataFrame, labels: DataFrame, toxic: int) -> list[bytes]:
    """Texts labelled ``toxic`` that aren't held out, in the order of a hash of their ids, within the bounds of the sample."""
    rows = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.col("toxic") == toxic)
    ranked = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_TEXTS)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(ranked, "doc_id").withColumn("size", F.octet_length("text"))
    sizes = texts.select("doc_id", "size").groupBy("doc_id").agg(F.max("size").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total, chosen = 0, []
    for r in sizes:
        if total + r["size"] <= TRAIN_BYTES:
            total += r["size"]
            chosen.append((r["doc_id"],))
    if not chosen:
        return []
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id long")
    found = texts.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text").collect()
    return [r["text"].encode() for r in sorted(found, key=lambda r: r["doc_id"])]


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Two dictionaries from two thirds of the sample, thresholds from the rest."""
    toxic, ordinary = sample(docs, labels, 1), sample(docs, labels, 0)
    split = [(x[: len(x) * 2 // 3], x[len(x) * 2 // 3 :]) for x in (toxic, ordinary)]
    marks = segments(split[0][0], split[1][0])
    usual, _ = stem_contexts(split[1][0])
    common = [b" " + w for w in sorted(usual, key=lambda w: (usual[w], w)) if usual[w] >= LEAST_CONTEXTS]
    own = Classifier(dictionary(marks), dictionary(common), (0.0, 0.0, 0.0))
    rest = [x.decode() for x in split[0][1] + split[1][1]]
    if not split[0][1] or not split[1][1]:
        return own._replace(weights=(-30.0, 0.0, 0.0))
    features = Distance(own.toxic, own.ordinary).features(pa.array(rest))
    return own._replace(weights=calibrated(features, np.repeat([1.0, 0.0], [len(split[0][1]), len(split[1][1])])))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, toxic).

    Of the rows with a label that aren't held out, at most TRAIN_TEXTS and TRAIN_BYTES of each class teach; labels of one id that differ
    count as toxic. Every word of every text is a window. Null and empty texts have none and get the score of a text without toxic
    windows; without labels of both classes all scores are near 0. A null id is an empty text when it is divided. Repeated rows each keep
    theirs; other columns are not read; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    own = tuple(train(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(*shared.value)
        distance = Distance(model.toxic, model.ordinary)
        base, *weights = model.weights
        for batch in batches:
            for part in slices(batch):
                score = 1 / (1 + np.exp(-np.clip(distance.features(part.column("text")) @ weights + base, -30, 30)))
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(work, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
