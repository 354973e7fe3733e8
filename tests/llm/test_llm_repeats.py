"""Repeated passages against every window of every text."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import in_order

from tributary.llm import repeats


def by_hand(rows):
    """Rows in corpus order; identical ones in any."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                covered[i : i + 100] = b"\1" * 100
            seen.add(window)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((doc_id, len(data), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(data, covered) if not c)).hexdigest()))
    return out


def planted(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice((60, 99, 100, 101, 130, 250)))) for _ in range(12)]
    fill = lambda: "".join(rng.choice("qwertz") for _ in range(rng.randrange(1, 90)))
    texts = [None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "z" * 350, "ab" * 150]
    texts += ["".join(rng.choice(passages) if rng.random() < 0.7 else fill() for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("hot", [5000, 2])
def test_planted_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    for seed in (1, 2):
        rows = planted(seed)
        got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert in_order(got) == in_order(by_hand(rows))


def test_documents(docs, rows):
    # Rows of one id are ordered by a hash of the text; here they are equal, or longer than the text that they repeat.
    ordered = sorted(((r.doc_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, len(r[1] or "")))
    got = in_order(repeats.remove_repeats(docs).collect())
    want = in_order(by_hand(ordered))
    assert [r for r in got if r[0] is not None] == [r for r in want if r[0] is not None]
    assert len(got) == len(want) and repeats.remove_repeats(docs.limit(0)).count() == 0


def test_rows_of_one_trigger_wait_until_it_is_hot(monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 5)
    g = np.repeat(np.arange(6), [1, 5, 6, 40, 2, 1])
    unit, n = np.arange(len(g)), np.where(np.arange(len(g)) == len(g) - 1, 2, 1)
    want = [(int(u), int(x), bool(n[g == x].sum() > 5)) for u, x in zip(unit, g) if n[g == x].sum() > 1]
    for size in (1, 3, 7, 100):
        rows = pa.table({"g": g, "unit": unit, "n": n}).to_batches(max_chunksize=size)
        got = [tuple(r.values()) for b in repeats.repeated(rows) for r in b.to_pylist()]
        assert got == want


def test_frequent_windows_do_not_wait(monkeypatch):
    """Of one window in many groups all rows but the first are repeats, however they are cut into batches; settled rows all are."""
    kind = np.repeat([repeats.WINDOWS, repeats.SETTLED], [12, 5]).astype(np.int32)
    key = np.array([1] * 9 + [2] * 1 + [3] * 2 + [7, 7, 8, 9, 9])
    place = np.arange(len(key))
    columns = {"kind": kind, "k": key, **{x: place for x in ("first_id", "uid", "crc", "pos")}, "amount": np.ones(len(key), np.int64)}
    rows = pa.table({**columns, "phrase": pa.array([b""] * len(key)), "unit": place})
    want = [*range(1, 9), 11, *range(12, 17)]
    for size in (1, 2, 5, 100):
        got = [r["uid"] for b in repeats.repeats(rows.to_batches(max_chunksize=size)) for r in b.to_pylist()]
        assert sorted(got) == want
