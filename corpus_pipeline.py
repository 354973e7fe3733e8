"""A corpus pipeline: each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.mixing import mixed_documents
from tributary.llm.packing import pack
from tributary.llm.pii import masked
from tributary.llm.quality import quality
from tributary.llm.queries import tokenizer_path
from tributary.llm.simhash import near_duplicates
from tributary.sources.folders import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's perplexity band go. The verdict depends on language and text
    only, and rows are matched by these, so rows with null or repeated ids have their own."""
    keyed = docs.withColumn("_verdict_of", F.xxhash64("lang", "text"))
    verdicts = quality(keyed.select(F.col("_verdict_of").alias("doc_id"), "lang", "text"))
    kept = verdicts.where("kept").select(F.col("doc_id").alias("_verdict_of")).distinct()
    return keyed.join(kept, "_verdict_of", "left_semi").select(docs.columns)


def near_duplicate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates stays. Rows with one id are one document; rows without
    an id stay."""
    found = near_duplicates(docs)
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.where(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi").select(docs.columns).unionAll(docs.where(F.col("doc_id").isNull()))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of personal data gives way to its kind in brackets."""
    return masked(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of what is left; the copies of a document are packed one by one."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicate_texts),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]
#: The stages learn models and encode tokens, which SQL can't express; tests compare them with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
