"""Suffix tree scores against every context counted in plain Python."""

import collections
import math
import pathlib
import shutil
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tributary.llm import suffix_tree


def contexts_of(tokens, i, depth):
    """The contexts of token ``i``, shortest first; what is before the text is one symbol, and the last."""
    for d in range(1, min(depth, i + 1) + 1):
        yield (("^",) if d == i + 1 else ()) + tuple(tokens[max(0, i - d) : i])


def by_hand(texts):
    train = [[*t.split(), "$"] for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    root = collections.Counter(x for t in train for x in t)
    total = sum(root.values())
    depth = max(2, int(math.log(total) / 2))
    follow = collections.defaultdict(collections.Counter)
    for t in train:
        for i, x in enumerate(t):
            for c in contexts_of(t, i, depth):
                follow[c][x] += 1
    follow[()] = root
    states = set()
    for c, n in follow.items():
        if c and sum(n.values()) >= 2:
            above = follow[c[1:]]
            gain = sum(k * math.log(k / sum(n.values()) / (above[x] / sum(above.values()))) for x, k in n.items())
            if gain > len(n) * math.log(total) / 2:
                states |= {c[i:] for i in range(len(c))}

    def p(c, x):
        if not c:
            return (root[x] + 1) / (total + len(root) + 1)
        if c not in states:
            return p(c[1:], x)
        n = follow[c]
        size = sum(n.values())
        return max(0, n[x] - 0.75) / size + 0.75 * len(n) / size * p(c[1:], x)

    out = {}
    for i, t in texts:
        t = [*t.split(), "$"]
        out[i] = sum(math.log10(p([(), *contexts_of(t, j, depth)][-1], x)) for j, x in enumerate(t))
    return out, {len(c) for c in states}


def texts_with_long_contexts():
    """After a, b or c, two words that tell nothing, then the word that only the one before these decides; and rare pairs of words."""
    rng = np.random.default_rng(5)
    said = {"a": "one", "b": "two", "c": "three"}
    out = []
    for i in range(60):
        parts = []
        for _ in range(60):
            first = rng.choice(list(said))
            parts += [first, "of", "the", said[first] if rng.random() < 0.95 else "none"]
        out.append((i, " ".join([*parts, *([f"rare{i // 6}", f"pair{i // 6}"] * (i % 3 > 0)), *["again"] * (i % 5)])))
    return [*out, (1000, "")]


@pytest.mark.parametrize("lookup", [1e-9, 1e-3, 1])
def test_scores_are_those_of_all_contexts(spark, monkeypatch, lookup):
    monkeypatch.setattr(suffix_tree, "LOOKUP_SHARE", lookup)
    texts = texts_with_long_contexts()
    want, lengths = by_hand(texts)
    assert max(lengths) >= 3
    got = {r.doc_id: r.score for r in suffix_tree.score(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_real_but_rare_contexts_are_kept(spark):
    """A pair of words seen three times among 90,000 has its own entry."""
    rng = np.random.default_rng(1)
    noise = [" ".join(f"w{x}" for x in rng.integers(0, 300, 3000)) for _ in range(30)]
    pair = [f"{t} quaint ferret" if i < 3 else t for i, t in enumerate(noise)]
    tree, _, _ = suffix_tree.fit(spark.createDataFrame([(t,) for t in pair], "text string"))
    assert (tree.states.weight_one < 0.3).sum() >= 1


def test_scores_are_those_of_all_contexts_if_few_go_on(spark, monkeypatch):
    """Long contexts among words that occur once go on without the other symbols."""
    split = []
    monkeypatch.setattr(suffix_tree, "rest_of", lambda *args, made=suffix_tree.rest_of: split.append(1) or made(*args))
    noise = [(2000 + i, " ".join(f"n{i}-{j}" for j in range(4000))) for i in range(60)]
    # Words that occur once where texts are learnt from, and once more elsewhere.
    learnt, out = ([i for i in range(3000, 3200) if (zlib.crc32(str(i).encode()) % 7 == 2) == held][:20] for held in (False, True))
    noise += [(i, f"a of the once{j} b of the two") for ids in (learnt, out) for j, i in enumerate(ids)]
    texts = [*texts_with_long_contexts(), *noise]
    want, lengths = by_hand(texts)
    assert max(lengths) >= 3
    got = {r.doc_id: r.score for r in suffix_tree.score(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert split and got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_pairs_are_stored_packed(spark, monkeypatch):
    """Files have few rows at any time, though nearly all of 200,000 pairs of words are distinct."""
    rng = np.random.default_rng(2)
    texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 20_000, 2000))) for i in range(100)]
    rows = []

    def drop(spark, folder):
        folder = pathlib.Path(folder)
        whole = next(p for p in (folder, *folder.parents) if p.name.startswith("suffix-tree-"))
        rows.append(sum(pq.read_metadata(f).num_rows for f in whole.rglob("*.parquet") if f.is_file()))
        shutil.rmtree(folder, ignore_errors=True)

    monkeypatch.setattr(suffix_tree, "drop_folder", drop)
    assert suffix_tree.score(spark.createDataFrame(texts, "doc_id long, text string")).count() == 100
    assert max(rows) < 2000


@pytest.mark.parametrize("replayed, few", [(1, 8), (2, 10**9), (9, 8)])
def test_scores_are_those_of_all_contexts_if_frequent_ones_are_dealt_over_ranges(spark, monkeypatch, replayed, few):
    """Frequent contexts have several keys, ranges are worked on in pieces, and what is known is written after any length."""
    for name, value in (("OFTEN", 20), ("OFTEN_SHARE", 0), ("SPLIT", 3), ("PAIRS", 500), ("REPLAYED", replayed), ("FEW", few), ("RELATION_BYTES", 3000)):
        monkeypatch.setattr(suffix_tree, name, value)
    texts = texts_with_long_contexts()
    want, _ = by_hand(texts)
    got = {r.doc_id: r.score for r in suffix_tree.score(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_slices_are_not_shuffled_again(spark, monkeypatch):
    """Each length's answers come to the slices, which stay in their buckets and are written once."""
    plans = []

    def kept(relation, *args, made=suffix_tree.told, **named):
        df = made(relation, *args, **named)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(suffix_tree, "told", kept)
    texts = texts_with_long_contexts()
    assert suffix_tree.score(spark.createDataFrame(texts, "doc_id long, text string")).count() == len(texts)
    assert len(plans) > 3 and all(plan.count("Exchange") <= 1 for plan in plans)


@pytest.mark.parametrize("bits", [3, 40])
def test_pairs_are_grouped_with_or_without_their_order(bits):
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 50, 1000) << bits for _ in range(2))
    first, place, of_a, of_b = suffix_tree.paired(a >> bits, b)
    assert (of_a[place] == a >> bits).all() and (of_b[place] == b).all() and (place[first] == np.arange(len(first))).all()
    assert len(first) == len(set(zip(a.tolist(), b.tolist())))
    assert all(len(x) == 0 for x in suffix_tree.paired(a[:0], b[:0]))


def test_numbers_come_back_from_packing():
    columns = [np.arange(300), np.zeros(0, np.int64), np.array([0.5, -1.25]), np.array([True, False]), np.array([2**63, 1], np.uint64)]
    back = suffix_tree.unpacked(suffix_tree.packed(*columns))
    assert len(back) == len(columns) and all((x == y).all() and len(x) == len(y) for x, y in zip(columns, back))
