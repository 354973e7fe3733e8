"""Periodic runs against every start and period tried by hand."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_cases import in_order, words

from tributary.llm.periods import collapse_runs, every_tenth_repeats, find_runs, inverse, run_digests, transform, zero_mismatches


def by_hand(w, least=12):
    runs = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                runs.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in runs.items())


def found(texts, least=12):
    bounds = np.cumsum([0, *map(len, texts)])
    codes = np.array([x for t in texts for x in t], np.int64)
    out = [[] for _ in texts]
    for t, *run in find_runs(codes, bounds, least).tolist():
        out[t].append(tuple(run))
    return [sorted(x) for x in out]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_texts(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        t = []
        while len(t) < rng.choice([0, 5, 40, 150]):
            part = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.choice([1, 2, 3, 6, 7, 8, 15, 16, 31]))]
            t += (part * rng.choice([1, 1, 2, 3, 9]))[: rng.choice([10**6, len(part) + 3])]
        texts.append(t)
    assert found(texts) == [by_hand(t) for t in texts]


def test_long_periods_and_one_word():
    rng = random.Random(3)
    long = [rng.randrange(10**6) for _ in range(700)]
    texts = [long * 2, [7] * 3000, long[:257] * 5 + long[:200], [1, 2] * 400 + [3] + [1, 2] * 400, [*range(100)], [], [5] * 11, [5] * 12]
    assert found(texts) == [by_hand(t) for t in texts]


def test_transforms_are_exact():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 15 * (1 << 27) + 1, (3, 16), np.uint64) for _ in range(2))
    prime = 15 * (1 << 27) + 1
    want = [[sum(int(x[i]) * int(y[(k - i) % 16]) for i in range(16)) % prime for k in range(16)] for x, y in zip(a, b)]
    assert inverse(transform(a) * transform(b) % np.uint64(prime)).tolist() == want
    values = np.array([5, 9, 5, 9, 5, 9, 9, 9], np.uint64)
    at, distance = zero_mismatches(values, np.array([0, 2, 4]), 2, 1, 6)
    assert [*zip(at.tolist(), distance.tolist())] == [(0, 2), (0, 4), (2, 2)]


def planted(doc_id, w):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_digests(docs, rows):
    want = []
    for r in rows:
        w = planted(r.doc_id, words(r.text))
        runs = by_hand(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone)
        runs = sorted(runs, key=lambda x: (x[0], x[2]))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        milli = best[1] * 1000 // best[2] if best[2] else None
        want.append((r.doc_id, len(runs), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, text))))
    got = run_digests(collapse_runs(docs, every_tenth_repeats))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert in_order(got.collect()) == in_order(want)
    assert sum(x[1] for x in want) > 10


def test_plain_texts_and_no_documents(spark, docs):
    same = "a b c " * 5
    odd = spark.createDataFrame([(1, same), (1, same), (None, None), (2, "")], "doc_id long, text string")
    got = in_order(collapse_runs(odd).collect())
    assert [(r[0], r[1], r[2], [tuple(x) for x in r[3]]) for r in got] == [(1, 15, "a b c", [(0, 15, 3)])] * 2 + [(2, 0, "", []), (None, 0, "", [])]
    assert collapse_runs(docs.limit(0)).count() == 0
