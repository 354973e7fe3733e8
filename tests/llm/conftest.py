import pytest
from llm_cases import CLASHING, FOLDER, ODD
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark):
    """The given documents, and odd, repeated and null rows, with columns that clash with the operators' own."""
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [(10**6 + i, t, "en" if i % 2 else None, f"odd{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(ODD)]
    same = "This very text is here several times, in rows of one id as well. " * 4
    rows += [(10**6 + 500, same, "en", "odd1", 1), (10**6 + 500, same, "en", "odd1", 1), (None, same, None, None, None), (None, "q w e r", None, None, None)]
    rows += [(10**6 + 501, same + "More.", "en", "odd1", 1)]
    every = given.unionAll(spark.createDataFrame(rows, given.schema)).coalesce(3)
    return every.withColumns({c: F.lit("clash") for c in CLASHING}).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return docs.select("doc_id", "text", "lang", "source").collect()
