"""SimHash links and components against all pairs."""

import random

import pytest
import xxhash
from llm_cases import in_order, lower, words

from tributary.llm.components import components
from tributary.llm.simhash import links, near_duplicates


def fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    found = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


@pytest.mark.parametrize("large", [1000, 1])
def test_components(docs, rows, large):
    own = [fingerprint(r.text) for r in rows]
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(own)):
        for j in range(i):
            if (own[i] ^ own[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    want = in_order((r.doc_id, f"{own[i]:016x}", least.get(find(i))) for i, r in enumerate(rows))
    assert in_order(near_duplicates(docs, large).collect()) == want


def test_no_documents(docs):
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("large", [1000, 5, 1])
def test_links_are_all_pairs_once(spark, large):
    rng, values = random.Random(1), set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        values.add(centre)
        for _ in range(20):
            other = centre
            for bit in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                other ^= 1 << bit
            values.add(other)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in values)
    want = sorted((a, b) for i, b in enumerate(signed) for a in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    got = [tuple(r) for r in links(spark.createDataFrame([(x,) for x in signed], "fp long"), large).collect()]
    assert sorted(got) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 150), 100)}
