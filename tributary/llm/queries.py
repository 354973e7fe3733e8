"""One query for each operator, over its whole table, and the pipeline. PATHS of tokenizers are parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies: in TOKENIZERS_DIR, or where the installed package says."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_perplexity_bands(spark: SparkSession, folder: str) -> DataFrame:
    from tributary.llm.quality import quality

    return quality(spark.read.parquet(f"{folder}/documents.parquet"))


def op2_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    from tributary.llm.repeats import remove_repeats

    return remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"))


def op3_graph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from tributary.llm.graph_index import search

    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from tributary.llm.token_counts import count_tokens, new_cache

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counted = count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), new_cache(spark))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    from tributary.llm.mixing import mix

    return mix(spark.read.parquet(f"{folder}/documents.parquet"))


def op6_compression_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from tributary.llm.toxicity import classify

    return classify(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))


def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from tributary.llm.pii import find_personal_data

    return find_personal_data(spark.read.parquet(f"{folder}/documents.parquet"))


def op8_suffix_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    from tributary.llm.suffix_tree import score

    return score(spark.read.parquet(f"{folder}/documents.parquet"))


def op9_simhash_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from tributary.llm.simhash import near_duplicates

    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from tributary.llm.packing import pack

    return pack(spark.read.parquet(f"{folder}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))


def op11_mine_phrases(spark: SparkSession, folder: str) -> DataFrame:
    from tributary.llm.phrases import mine_phrases

    return mine_phrases(spark.read.parquet(f"{folder}/documents.parquet"))


def op12_page_differences(spark: SparkSession, folder: str) -> DataFrame:
    from tributary.llm.pages import extract_articles

    return extract_articles(spark.read.parquet(f"{folder}/pages.parquet"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    from tributary.llm.periods import collapse_runs, every_tenth_repeats, run_digests

    return run_digests(collapse_runs(spark.read.parquet(f"{folder}/documents.parquet"), every_tenth_repeats))


from tributary.llm.mixing import MIX_SQL  # noqa: E402
from tributary.llm.phrases import PHRASES_SQL  # noqa: E402

QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_perplexity_bands, op2_repeated_passages, op3_graph_neighbours, op4_token_counts, op5_mix_sources, op6_compression_toxicity, op7_personal_data, op8_suffix_tree_scores, op9_simhash_duplicates, op10_best_fit_packing, op11_mine_phrases, op12_page_differences, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op5_mix_sources": MIX_SQL, "op11_mine_phrases": PHRASES_SQL}
