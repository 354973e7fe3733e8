"""Quality rules and suffix tree scores."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from llm_cases import FOLDER, lower, words

from tributary.llm import suffix_tree
from tributary.llm.grams import BITS, FIRST_WORD, ONE
from tributary.llm.quality import fit, quality


def base(text):
    text, w = text or "", words(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        again += bool(words(line)) and line in seen
        seen.add(line)
    windows, inside = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


@pytest.fixture(scope="module")
def judged(docs):
    return quality(docs).collect()


def test_base_counts(judged, rows):
    def all_of(found):
        return sorted(map(str, found))

    want = []
    for r in rows:
        b = base(r.text)
        want.append((r.doc_id, r.lang, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    got = [(r.doc_id, r.lang, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged]
    assert all_of(got) == all_of(want)
    assert not any(r.kept and r.base_failed for r in judged)
    assert all(r.kept == (r.lower <= r.log_perplexity <= r.upper) for r in judged if not r.base_failed)


def test_bands_reject_junk_and_keep_the_rest(spark):
    folder = FOLDER.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = quality(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    good = [r.kept for r in judged if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in judged if labels.get(r.doc_id) == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_the_model_is_a_distribution(spark):
    """Probabilities after any context sum to 1, with and without pruned n-grams."""
    texts = spark.createDataFrame([(t,) for t in ("a b c a b d", "a b c", "c c b a", "b d a b c e", "") for _ in range(3)], "text string")
    for share in (1e-6, 0.05, 0.2):
        model = fit(texts, word_share=0.05, gram_share=share)
        every = np.arange(FIRST_WORD + len(model.vocabulary))
        for second in (0, FIRST_WORD, FIRST_WORD + 1, 5):
            for first in (0, FIRST_WORD, FIRST_WORD + 2, 9):
                keys = (second << 2 * BITS) | (first << BITS) | every
                assert abs((10 ** model.log10(keys)).sum() - 1) < 1e-5
    assert ONE


def test_empty_tables(docs):
    assert quality(docs.limit(0)).count() == 0
    assert suffix_tree.score(docs.limit(0)).count() == 0


@pytest.mark.parametrize("lookup", [1e-6, 1e-4])
def test_base_scores(docs, rows, monkeypatch, lookup):
    monkeypatch.setattr(suffix_tree, "LOOKUP_SHARE", lookup)

    def tokens(text):
        return [*words(lower(text)), None]

    def out(doc_id):
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2

    counts = collections.Counter()
    for r in rows:
        if not out(r.doc_id):
            counts.update(tokens(r.text))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        t = tokens(r.text)
        want.append((str(r.doc_id), out(r.doc_id), len(t), sum(counts[x] > 0 for x in t), total, round(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in t), 4)))
    got = suffix_tree.score(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(want)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in got)


@pytest.mark.parametrize("words_of_text, state", [(["p", "q", "r"], False), (["x y", "p", "q"], True)])
def test_contexts_that_tell_nothing_are_no_states(spark, words_of_text, state):
    """Nothing follows from independent words; "y" always follows "x"."""
    rng = np.random.default_rng(0)
    texts = [(" ".join(rng.choice(words_of_text) for _ in range(300)),) for _ in range(20)]
    tree, counts, _ = suffix_tree.fit(spark.createDataFrame(texts, "text string"))
    weights = tree.states.weight_one[FIRST_WORD:]
    assert (weights < 0.1).any() == state and len(weights) == len(set(" ".join(words_of_text).split()))
    assert counts.columns == ["key", "last", "n"]
