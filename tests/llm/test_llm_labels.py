"""Toxicity and personal data."""

import hashlib
import re
import zlib

import pytest
from llm_cases import FOLDER
from pyspark.sql import functions as F

from tributary.llm import crf
from tributary.llm.pii import base_spans, find_personal_data, masked
from tributary.llm.toxicity import classify


def test_toxicity_on_held_out_rows(spark):
    folder = FOLDER.replace("sf0.001", "sf0.1")
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in classify(documents, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    right = sum(p and t for p, t in held)
    assert right >= 0.8 * sum(t for _, t in held) and right >= 0.8 * sum(p for p, _ in held)


def test_toxicity_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    got = classify(docs, labels).collect()
    assert len(got) == docs.count() and all(r.predicted == 0 for r in got)
    assert classify(docs.limit(0), labels).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = [int(c) for c in text if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def by_hand(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if passes(k, m[0])] for k, p in PATTERNS.items()}


def test_base_spans(docs, rows):
    got = find_personal_data(docs).collect()

    def row(doc_id, text):
        found = by_hand(text)
        listed = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in found[k])
        return doc_id, *(len(found[k]) for k in PATTERNS), hashlib.sha256(listed.encode()).hexdigest()

    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, (row(r.doc_id, r.text) for r in rows)))
    texts = {r.doc_id: r.text for r in rows if r.doc_id}
    for r in got:
        own = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert own == sorted(own, key=lambda x: (list(PATTERNS).index(x[0]), int(x[1])))
        if r.doc_id:
            assert {(k, str(a), str(b)) for k, v in by_hand(texts[r.doc_id]).items() for a, b in v} <= set(own)
    assert find_personal_data(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["1.2.3.4.5", "0000255.1.1.1 256.1.1.1", "a@b@c.com", "@@@a@b.c", "+1" * 50, "4111 1111 1111 1111 1", "0" * 400, "1-" * 50, "+1 " + " " * 50, "x.y+z@-.-"])
def test_base_spans_of_hard_texts(text):
    assert base_spans(text) == by_hand(text)


def test_the_field_finds_other_spellings(spark):
    texts = {
        "write to bob at mail dot com today": "write to [EMAIL] today", "host 10[.]0[.]3[.]4, up": "host [IP], up", "card 4111.1111.1111.1111 here": "card [CARD] here",
        "call 555-123-4567.": "call [PHONE].", "nothing at 12:30 on 2024-10-05, version 1.2.3": None, "look at the dot com boom": None, "order 348678214084 is late": None,
    }
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_chars", F.lit(0).cast("long"))
    got = {r.doc_id: r for r in masked(table).collect()}
    for i, (text, want) in enumerate(texts.items()):
        assert got[i].text == (want or text) and got[i].n_chars == len(want or text)


def test_masking_keeps_rows_and_columns(docs):
    got = masked(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert got.where(F.col("text").isNull()).count() == docs.where(F.col("text").isNull()).count()


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    score, moves = rng.normal(size=(9, crf.LABELS)), rng.normal(size=(crf.LABELS, crf.LABELS))
    bounds = np.array([0, 1, 5, 9])
    got = crf.viterbi(score, bounds, moves)
    for a, b in zip(bounds, bounds[1:]):
        def total(path):
            steps = [0, *path, 0]
            return sum(score[a + i, x] for i, x in enumerate(path)) + sum(moves[x, y] for x, y in zip(steps, steps[1:]))

        best = max(itertools.product(range(crf.LABELS), repeat=b - a), key=total)
        assert tuple(got[a:b]) == best
