"""The pipeline's stages against plain versions of each on its own input."""

import collections

import corpus_pipeline
from llm_cases import FOLDER
from pyspark.sql import functions as F

from tributary.llm.mixing import mix
from tributary.llm.quality import quality
from tributary.llm.simhash import near_duplicates


def test_stages(spark, docs, tmp_path):
    documents = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, documents, FOLDER)
        result.write.parquet(f"{tmp_path}/{n}")
        result = spark.read.parquet(f"{tmp_path}/{n}")
        before, after = ([r.doc_id for r in x.select("doc_id").collect()] for x in (documents, result))
        if n < 4:
            assert result.columns == documents.columns
        if name == "quality rules":
            assert collections.Counter(after) == collections.Counter(r.doc_id for r in quality(documents).where("kept").collect())
        elif name == "SimHash near-dedup":
            groups = near_duplicates(documents).where(F.col("doc_id").isNotNull()).collect()
            assert set(after) - {None} == {r.component_id for r in groups}
        elif name == "PII":
            assert sorted(map(str, before)) == sorted(map(str, after))
        elif name == "mixing sources to target weights":
            times = collections.Counter()
            for r in mix(documents).collect():
                times[r.doc_id] += r.taken // r["size"] if r["size"] else 0
            assert {k: v for k, v in times.items() if v} == collections.Counter(after)
        else:
            assert set(before) == set(after) and collections.Counter(before) == collections.Counter(r.doc_id for r in result.where("piece = 0").collect())
        documents = result


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.count() > 0 and "sequence_id" in got.columns


def test_no_documents_and_clashing_columns(spark, docs):
    some = docs.where("doc_id < 40 or doc_id >= 1000000 or doc_id is null").cache()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, some.limit(0), FOLDER).count() == 0
        result = stage(spark, some, FOLDER)
        assert result.count() > 0
        if name != "best-fit packing":
            assert result.columns == some.columns
    some.unpersist()
