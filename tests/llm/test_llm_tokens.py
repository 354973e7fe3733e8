"""Token counts and packing against the tokenizer library."""

import collections
import random
import zlib

import numpy as np
import pytest
from llm_cases import in_order
from tokenizers import Tokenizer

from tributary.llm.packing import pack, plan
from tributary.llm.queries import tokenizer_path
from tributary.llm.token_counts import CACHE, count_tokens, new_cache


def test_counts_are_the_librarys_and_the_cache_is_used(spark, docs, rows):
    path = tokenizer_path("byte_bpe_50k.json")
    library, cache = Tokenizer.from_file(path), new_cache(spark)
    want = in_order((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    assert in_order(count_tokens(docs, path, cache).collect()) == want
    stored = spark.read.schema(CACHE).parquet(cache).count()
    assert stored == len({r.text or "" for r in rows})
    assert in_order(count_tokens(docs, path, cache).collect()) == want
    assert spark.read.schema(CACHE).parquet(cache).count() == stored
    assert count_tokens(docs.limit(0), path, new_cache(spark)).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_files_count_whole_texts(spark, docs, rows, name):
    path = tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        library = Tokenizer.from_file(path)
        encode = lambda t: library.encode(t, add_special_tokens=False).ids
    got = count_tokens(docs, path, new_cache(spark)).collect()
    assert in_order(got) == in_order((r.doc_id, len((r.text or "").encode()), len(encode(r.text or ""))) for r in rows)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(docs, rows, capacity):
    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = []
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, i // capacity, i, len(ids[i : i + capacity]), zlib.crc32(ids[i : i + capacity].tobytes())) for i in range(0, len(ids), capacity)]
    got = pack(docs, path, capacity).collect()
    assert in_order(r[:5] for r in got) == in_order(want)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [at for at, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= capacity
    assert len(sequences) <= 1.1 * -(-sum(r["length"] for r in got) // capacity) + 1
    assert pack(docs.limit(0), path).count() == 0


def by_hand(lengths, capacity):
    """Best fit one document at a time: the longest above a third first, each with the longest that fits, then the rest."""
    bins = []
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    while large:
        n = large.pop(0)
        beside = next((x for x in large if x + n <= capacity), None)
        if beside:
            large.remove(beside)
        bins.append(capacity - n - (beside or 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [i for i, gap in enumerate(bins) if gap >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(8))
def test_the_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 100, 333])
    lengths = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(rng.choice([1, 30, 400]))]
    ranges = plan(collections.Counter(lengths), capacity)
    filled = collections.Counter()
    for length, count in collections.Counter(lengths).items():
        own = ranges[ranges[:, 0] == length]
        for rank in range(count):
            _, first_rank, each, first, _ = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            filled[first + (rank - first_rank) // each] += length
    assert max(filled.values()) <= capacity and len(filled) == by_hand(lengths, capacity)
