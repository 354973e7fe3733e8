"""Token counts behind a cache keyed by content and tokenizer digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.text import binary, coded, memo, raw, slices, small_batches, sums
from tributary.sources.folders import shared_folder

CACHE = "tokenizer string, content string, n_tokens long"
#: Pieces of text whose counts one Python worker remembers.
REMEMBERED = 150_000
#: Characters that never share a token with a letter before them, nor with a special token's text.
CLOSING = np.zeros(256, bool)
CLOSING[list(b".,;:!?%$&*#")] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def pieces(array: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Texts cut where byte-level BPE always starts a new word: before a space that precedes a visible ASCII character, and
    between an ASCII letter and a closing mark. Codes, distinct pieces and each row's bounds."""
    offsets, data = raw(array)
    begins = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        visible = (data[1:] > 32) & (data[1:] < 127)
        begins[:-2] |= (data[:-1] == 32) & visible
        begins[1:-1] |= LETTER[data[:-1]] & CLOSING[data[1:]]
    begins[offsets] = True
    begins[-1] = True
    at = np.flatnonzero(begins)
    codes, values = coded(binary(at, data))
    return codes, values, np.searchsorted(at, offsets)


class PieceCounter:
    """Counts tokens of byte-level BPE files of the ``tokenizers`` library, remembering pieces seen before."""

    def __init__(self, definition: str, digest: str) -> None:
        from tokenizers import Tokenizer

        held = memo(f"counts-{digest}")
        if "tokenizer" not in held:
            held["tokenizer"], held["known"] = Tokenizer.from_str(definition), {}
            held["tokenizer"].no_truncation()
            held["tokenizer"].no_padding()
        self.tokenizer, self.known = held["tokenizer"], held["known"]

    def counts(self, array: pa.Array) -> np.ndarray:
        codes, values, bounds = pieces(array)
        values = values.to_pylist()
        found = [self.known.get(x, -1) for x in values]
        new = [i for i, n in enumerate(found) if n < 0]
        encoded = self.tokenizer.encode_batch_fast([values[i].decode() for i in new], add_special_tokens=False)
        for i, e in zip(new, encoded):
            found[i] = len(e)
            if len(self.known) < REMEMBERED:
                self.known[values[i]] = found[i]
        return sums(np.asarray(found, np.int64)[codes] if len(codes) else codes, bounds)


class WholeCounter:
    """Counts tokens of any other file: whole texts, as the library gives them."""

    def __init__(self, definition: str | bytes, digest: str) -> None:
        held = memo(f"whole-{digest}")
        if "encode" not in held:
            if isinstance(definition, bytes):
                import sentencepiece

                model = sentencepiece.SentencePieceProcessor(model_proto=definition)
                held["encode"] = lambda texts: model.encode(texts, num_threads=1)
            else:
                from tokenizers import Tokenizer

                tokenizer = Tokenizer.from_str(definition)
                tokenizer.no_truncation()
                tokenizer.no_padding()
                held["encode"] = lambda texts: tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        self.encode = held["encode"]

    def counts(self, array: pa.Array) -> np.ndarray:
        return np.fromiter(map(len, self.encode(array.to_pylist())), np.int64, len(array))


def load(path: str) -> tuple[str | bytes, str, bool]:
    """A tokenizer file's definition, its digest, and whether its texts may be cut by ``pieces``."""
    with open(path, "rb") as file:
        content = file.read()
    digest = hashlib.sha256(content).hexdigest()
    if path.endswith(".model"):
        return content, digest, False
    import json

    rules = json.loads(content)
    before = rules.get("pre_tokenizer") or {}
    plain = (
        rules.get("normalizer") is None
        and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        and not any(
            x["lstrip"] or x["rstrip"] or x["single_word"] or any(" " in x["content"] or LETTER[a] and CLOSING[b] for a, b in zip(x["content"].encode(), x["content"].encode()[1:]))
            for x in rules.get("added_tokens", ())
        )
    )
    return content.decode(), digest, plain


def count_tokens(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs`` (doc_id, text); null texts count as empty.

    The cache is a Parquet table of (tokenizer digest, content digest, n_tokens) in the folder ``cache`` that all executors
    reach, made if there is none. Digests of all texts are looked up there; each distinct text that is missing
    is encoded once, and its count is appended to the cache before the counts are joined to the rows by digest.
    The content's normal form is the text itself, as the files' own normalisers change nothing that a count may ignore.
    Special strings are handled as by default, none are added. Rows that repeat a text or an id each keep
    their row; other columns are not read; an empty table gives none. An append that is repeated after
    a failure writes the same counts, so the lookup takes one row a digest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    definition, version, plain = load(tokenizer)
    content = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", content.alias("text")).withColumn("content", F.sha2("text", 256))

    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).select("content", "n_tokens")
    missing = texts.select("content", "text").join(stored.select("content"), "content", "left_anti").dropDuplicates(["content"])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = (PieceCounter if plain else WholeCounter)(definition, version)
        for batch in batches:
            for part in slices(batch):
                n = pa.array(counter.counts(part.column("text")), pa.int64())
                yield pa.record_batch([pa.array([version] * len(part), pa.string()), part.column("content"), n], ["tokenizer", "content", "n_tokens"])

    missing.select("content", "text").mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    known = known.groupBy("content").agg(F.first("n_tokens").alias("n_tokens"))
    rows = texts.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(known, "content", "left").select("doc_id", "n_bytes", "n_tokens")


def new_cache(spark) -> str:
    return shared_folder(spark, "token-counts")
