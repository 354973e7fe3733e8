"""Phrases against counting by hand."""

import collections
import re

import pytest
from llm_cases import lower

from tributary.llm.phrases import mine_phrases


def by_hand(texts, top, least, longest=4):
    out = []
    for lang in {lang or "und" for lang, _ in texts}:
        counts, n = collections.Counter(), 0
        for own, text in texts:
            if (own or "und") == lang:
                for piece in re.split("[.,;:!?\n-\r]", lower(text)):
                    w = re.findall("[^ \t]+", piece)
                    n += len(w)
                    counts.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        hidden = {}
        for p, a in chosen.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    hidden[p[i : i + k]] = max(hidden.get(p[i : i + k], 0), a)
        rows = []
        for p, a in chosen.items():
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if not 100 * hidden.get(p, 0) >= 80 * a:
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n, -score) for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("top", "least"), [(2000, 30), (40, 3)])
def test_phrases(docs, rows, top, least):
    got = mine_phrases(docs, top, least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = by_hand([(r.lang, r.text) for r in rows], top, least)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 20


def test_pieces_ties_and_repeated_rows(spark):
    texts = [("x", "A b\tc, a b. a\nb a b c d"), ("x", "a b c d"), ("x", "a b c d"), ("und", "e f"), (None, "e F;e f"), ("y", None), ("y", ""), (None, "é É é É é É")]
    docs = spark.createDataFrame(texts, "lang string, text string")
    got = sorted(tuple(r) for r in mine_phrases(docs, 5, 2).collect())
    assert got == by_hand(texts, 5, 2)


def test_no_documents(docs):
    assert mine_phrases(docs.limit(0)).count() == 0
