"""A probabilistic suffix tree over words, with contexts of any length, and log10 probabilities of texts."""

from __future__ import annotations

import gc
import math
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.grams import FIRST_WORD, drop_folder, find, frequent, signed, word_counts
from tributary.llm.text import HashedWords, cut, give_back, hashed_words, mixed, raw, slices, small_batches, sums
from tributary.sources.folders import shared_folder

#: ``weight_one`` has the words of this share, 1 / LOOKUP_SHARE at most. Scores are the same with any share.
LOOKUP_SHARE = 1e-6
#: A context may be a state if it occurs so often, whatever the size of the corpus.
LEAST = 2
DISCOUNT = 0.75
#: Stand for a text's end as a symbol, and for what is before it in a context.
END, BEFORE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Text behind one row of the relation, and text for which there is a range of keys.
RELATION_BYTES, RANGE_BYTES = 8 << 20, 32 << 20
#: Symbols go on to longer contexts by themselves once no more than the FEWth part is left.
FEW = 8
#: Pairs that are put in order at once, by who gets a range.
PAIRS = 1 << 19
#: The contexts of so many lengths are worked out from their answers at each later length; then what is known is written beside the slices.
REPLAYED = 2
#: A context is asked for under SPLIT keys if it occurs more often than both, the second as a share of all tokens.
OFTEN, OFTEN_SHARE, SPLIT = 1 << 15, 1 / 1024, 64
#: Text for which deleting what was shuffled is worth a wait.
WAITED = 64 << 20
#: Flags of a context.
STATE, GROWN = 1, 2
#: A row has the symbols of one slice of the texts, as places in the list of its distinct words, beside which stands how often each occurs where texts are learnt
#: from. ``known`` has what answers told of the words and of contexts, length by length; ``start`` is for rows that have only what longer ones need.
#: ``symbols``, ``tokens`` and ``texts`` count all symbols, those to learn from, and texts to learn from.
RELATION = (
    "slice long, docs array<long>, held array<boolean>, bounds binary, words binary, codes binary, known array<binary>, start array<binary>,"
    " symbols long, tokens long, texts long"
)
#: What is known of a slice, beside the row of its symbols.
KNOWN = "slice long, known array<binary>"
MESSAGE = "slice long, bucket long, columns binary"
#: ``about`` adds up to what the answers tell about the corpus.
REPLY = f"{MESSAGE}, about double, level long"


class States(NamedTuple):
    """``weight_one``: what a frequent word, from FIRST_WORD on, as a context leaves for the root; 1 if it is no state. ``depth``: the longest context's length."""

    depth: int
    weight_one: np.ndarray


class Tree(NamedTuple):
    """``values`` (key, v) has every state and entry. A word's log10 probability after a text is the root's, and the values of all states that the
    text ends with and of their entries for the word."""

    states: States
    values: DataFrame
    lookup: np.ndarray
    counts: np.ndarray
    texts: int
    tokens: int
    distinct: int


class Corpus(NamedTuple):
    """What every slice knows of all: tokens and texts to learn from, the longest context's length, and the number of bits that tell the ranges of keys."""

    tokens: int
    texts: int
    depth: int
    bits: int

    def ranged(self, size: float) -> Corpus:
        """With ranges for symbols of so many bytes."""
        return self._replace(bits=max(3, (int(size) // RANGE_BYTES).bit_length()))

    @property
    def cost(self) -> float:
        return math.log(max(2, self.tokens)) / 2

    @property
    def often(self) -> float:
        """Contexts that occur more often are dealt over SPLIT ranges, by what follows them."""
        return max(OFTEN, OFTEN_SHARE * self.tokens)


def symbols(low: HashedWords) -> tuple[np.ndarray, np.ndarray]:
    """The words and each text's end, and the texts' bounds."""
    return np.insert(low.hashes, low.bounds[1:], END), low.bounds + np.arange(len(low.bounds))


def small(x: np.ndarray) -> np.ndarray:
    """Numbers, whole ones in as few bytes as hold them."""
    return x if x.dtype.kind == "f" else x.astype(np.min_scalar_type(int(x.max(initial=0))))


def packed(*columns: np.ndarray) -> bytes:
    """Numbers, as ``small`` has them, the lowest bytes first for compression, behind their types and how many they are."""
    head, planes = [bytes([len(columns)])], [np.zeros(0, np.uint8)]
    for x in map(small, columns):
        head.append(x.dtype.str.encode() + len(x).to_bytes(8, "little"))
        planes.append(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).reshape(-1))
    return b"".join(head) + pa.compress(np.concatenate(planes), "zstd", asbytes=True)


def unpacked(data: bytes | memoryview) -> list[np.ndarray]:
    heads = [bytes(data[at : at + 11]) for at in range(1, 1 + 11 * data[0], 11)]
    types, sizes = [np.dtype(x[:3].decode()) for x in heads], [int.from_bytes(x[3:], "little") for x in heads]
    edges = np.cumsum([0, *[t.itemsize * n for t, n in zip(types, sizes)]])
    planes = np.frombuffer(pa.decompress(memoryview(data)[1 + 11 * data[0] :], int(edges[-1]), "zstd"), np.uint8)
    return [np.ascontiguousarray(planes[a : a + t.itemsize * n].reshape(t.itemsize, n).T).view(t).reshape(-1) for t, n, a in zip(types, sizes, edges)]


def together(parts: list[bytes], columns: int) -> list[np.ndarray]:
    """The columns of all ``parts``, one part after another."""
    every = [unpacked(x) for x in parts]
    found = [np.concatenate([np.zeros(0, np.uint8), *x]) for x in zip(*every)] or [np.zeros(0, np.int64)] * columns
    return [x if x.dtype.kind == "f" else x.astype(np.int64) for x in found]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the first of each distinct one of ``keys`` is, by order, and each key's place among the distinct ones."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    keys = keys[order]
    new[1:] = keys[1:] != keys[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def paired(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``grouped`` by both, and both of each distinct pair. Numbers of 64 bits are sorted by themselves much faster than with their order."""
    low, place, size = int(b.max(initial=0)).bit_length(), len(a).bit_length(), int(a.max(initial=0)).bit_length()
    keys = (a.astype(np.uint64) << np.uint64(low)) | b.astype(np.uint64)
    if low + place + size > 64:
        first, places = grouped(keys)
        keys = keys[first]
    else:
        keys <<= np.uint64(place)
        keys |= np.arange(len(a), dtype=np.uint64)
        keys.sort()
        order = (keys & np.uint64((1 << place) - 1)).astype(np.int64)
        keys >>= np.uint64(place)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        places = np.empty(len(keys), np.int64)
        places[order] = np.cumsum(new) - 1
        first, keys = order[new], keys[new]
    return first, places, (keys >> np.uint64(low)).astype(np.int64), (keys & np.uint64((1 << low) - 1)).astype(np.int64)


def judged(total: np.ndarray, most: np.ndarray, distinct: np.ndarray, gain: np.ndarray, over: np.ndarray, cost: float) -> np.ndarray:
    """Flags of contexts that occur ``total`` times, followed by ``distinct`` symbols, one of them ``most`` times. ``over``: how often the next shorter one occurs.

    A context is a state if it occurs LEAST times and the gain in log likelihood over the shorter one is more than half the logarithm of the number
    of tokens for each of its symbols. A longer context's gain can exceed that for a symbol only if n * log(total / n) does here, since neither n nor
    total - n is larger there; GROWN is a bound of that by the largest n, so that no context is missed.
    """
    found, some = total >= LEAST, np.maximum(total, 1)
    logs = gain + total * np.log(np.maximum(over, 1)) - total * np.log(some)
    other = np.minimum(total - most, total / math.e)
    bound = np.maximum(most * np.log(some / np.maximum(most, 1)), np.where(other > 0, other * np.log(some / np.where(other > 0, other, 1)), 0.0))
    return np.where(found & (logs > distinct * cost), STATE, 0) + np.where(found & (bound > cost), GROWN, 0)


def rows_as(schema: str, rows: list[dict]) -> pa.RecordBatch:
    types = {
        "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<binary>": pa.list_(pa.binary()),
    }
    fields = [field.split() for field in schema.split(",")]
    return pa.record_batch([pa.array([row.get(name) for row in rows], types[kind]) for name, kind in fields], [name for name, _ in fields])


def slice_row(number: int, parts: list[tuple]) -> dict:
    """A row of the relation: ``parts`` have symbols, bounds, ids of texts, and which are held out."""
    current = np.concatenate([x[0] for x in parts])
    lengths = np.concatenate([np.diff(x[1]) for x in parts])
    held = np.concatenate([x[3] for x in parts])
    coded = pa.array(current).dictionary_encode()
    words, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
    # Frequent words first.
    often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    place = np.empty(len(often), np.int64)
    place[often] = np.arange(len(often))
    codes = place[codes]
    own = np.bincount(codes[~np.repeat(held, lengths)], minlength=len(often))
    return {
        "slice": number, "docs": [d for x in parts for d in x[2]], "held": held.tolist(), "bounds": packed(np.append(0, np.cumsum(lengths))),
        "words": packed(words[often], own), "codes": packed(codes), "known": [], "start": [],
        "symbols": len(codes), "tokens": int(lengths[~held].sum()), "texts": int((~held).sum()),
    }


def relation_of(texts: DataFrame) -> DataFrame:
    """The relation of ``texts`` (doc_id, text, held_out)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in slices(batch, limit=RELATION_BYTES // 2):
                offsets, data = raw(part.column("text"))
                if parts and size + len(data) > RELATION_BYTES:
                    yield rows_as(RELATION, [slice_row(number, parts)])
                    number, parts, size = number + 1, [], 0
                held = part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                parts.append((*symbols(hashed_words(offsets, data, lower=True)), part.column("doc_id").cast(pa.int64()).to_pylist(), held))
                size += len(data)
        if parts:
            yield rows_as(RELATION, [slice_row(number, parts)])
        del parts
        give_back()

    return texts.select("doc_id", "text", "held_out").mapInArrow(work, RELATION)


def by_range(number: int, keys: np.ndarray, columns: list[np.ndarray], bits: int, inner: list[np.ndarray] = (), edges: np.ndarray | None = None) -> pa.RecordBatch:
    """What a slice asks about sorted ``keys``, by ranges of them. ``inner`` columns have the values ``edges[i]:edges[i + 1]`` for key i."""
    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    cuts = np.concatenate(([0], cuts, [len(keys)]))
    rows = []
    for bucket in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[bucket], cuts[bucket + 1]
        rows.append({"slice": number, "bucket": bucket, "columns": packed(keys[a:b], *[x[a:b] for x in columns], *[x[edges[a] : edges[b]] for x in inner])})
    return rows_as(MESSAGE, rows)


class Level(NamedTuple):
    """The contexts of one length at the symbols ``at`` that can occur LEAST times: the symbol ``at[i]``, which follows its context ``n[i]`` times, has the context
    ``which[i]``; of one word it is that word's place, or, before a text, the one behind. ``total``, ``distinct`` and ``flags`` are the contexts', where they are states or may have longer ones."""

    at: np.ndarray
    which: np.ndarray
    n: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    flags: np.ndarray


class Asked(NamedTuple):
    """What is asked of contexts one longer: those ``used``, of ``count``, that follow ``over`` shorter ones. ``order`` sorts ``keys``: the contexts but those ``hot``, then SPLIT for each of
    these. Each has ``sizes`` distinct symbols behind it; ``pair`` is the place of each symbol's, ``first`` the first symbol that has one."""

    at: np.ndarray
    which: np.ndarray
    count: int
    used: np.ndarray
    over: np.ndarray
    hot: np.ndarray
    keys: np.ndarray
    order: np.ndarray
    pair: np.ndarray
    first: np.ndarray
    sizes: np.ndarray


class Slice:
    """One row of the relation, brought by its answers to the contexts of length ``level``."""

    def __init__(self, row: dict, corpus: Corpus) -> None:
        self.row, self.corpus = row, corpus
        self.words, self.own = unpacked(row["words"])
        self.words, self.codes = self.words.astype(np.uint64), unpacked(row["codes"])[0].astype(np.int64)
        self.levels: list[Level] = []
        self.level = -1
        if row["start"]:
            at, which, total, bound, places, held, ids, level = (unpacked(x)[0] for x in row["start"])
            self.at, self.which, self.total, self.bound, self.places, ids = (x.astype(np.int64) for x in (at, which, total, bound, places, ids))
            self.held, self.level = held.astype(bool), int(level[0])
            self.number(ids)
            return
        self.bounds = unpacked(row["bounds"])[0].astype(np.int64)
        lengths = np.diff(self.bounds)
        self.held = np.repeat(np.asarray(row["held"], bool), lengths)
        self.places = np.arange(len(self.codes)) - np.repeat(self.bounds[:-1], lengths)
        if row["known"]:
            self.count_words(*(x.astype(np.int64) for x in unpacked(row["known"][0])))
            for data in row["known"][1:]:
                steps, which, *rest = (x.astype(np.int64) for x in unpacked(data))
                at, which = (np.cumsum(steps), which) if self.levels else self.first_contexts()
                self.add(Level(at, which, *rest))

    def number(self, ids: np.ndarray) -> None:
        self.ids, self.split = ids, (mixed(ids) % np.uint64(SPLIT)).astype(np.int64)

    def count_words(self, counts: np.ndarray, ids: np.ndarray) -> None:
        self.number(ids)
        self.counts, self.level = counts, 0
        self.at, self.bound = np.arange(len(self.codes)), counts[self.codes]

    def first_contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """The symbols whose contexts of one word can occur LEAST times, and these contexts."""
        before = np.empty(len(self.codes), np.int64)
        before[1:] = self.codes[:-1]
        before[self.bounds[:-1]] = len(self.words)
        at = np.flatnonzero(np.append(self.counts, self.corpus.texts)[before] >= LEAST)
        return at, before[at]

    def hashes(self, at: np.ndarray, level: int) -> np.ndarray:
        """The contexts of a length of the symbols ``at``. What stands before a text is its first symbol."""
        context, places = np.zeros(len(at), np.uint64), self.places[at]
        for k in range(1, level + 1):
            before = self.words[self.codes[np.maximum(at - k, 0)]]
            before[places < k] = BEFORE
            context = mixed(context * STEP + before)
        return context

    def contexts(self, k: int) -> np.ndarray:
        """All contexts of a known length."""
        if k == 1:
            return mixed(np.append(self.words, BEFORE))
        level = self.levels[k - 1]
        at = np.empty(len(level.total), np.int64)
        at[level.which] = level.at
        return self.hashes(at, k)

    def asking(self) -> Asked:
        """What it asks about the contexts one longer."""
        level = self.level + 1
        if level == 1:
            at, which = self.first_contexts()
            count = len(self.words) + 1
            used = np.flatnonzero(np.bincount(which, minlength=count))
            contexts, over, size = self.contexts(1)[used], np.full(len(used), self.corpus.tokens), np.append(self.counts, self.corpus.texts)[used]
        else:
            # No context can be followed by a symbol more often than a shorter one; and one occurs as often as its last word follows the words before it.
            places, size = self.places[self.at], self.bound[self.at - 1]
            there = np.flatnonzero((places >= level - 1) & (size >= LEAST))
            at, parent = self.at[there], self.which[there]
            before = self.codes[np.maximum(at - level, 0)] + 1
            before[places[there] < level] = 0
            first, which, parent, _ = paired(parent, before)
            count, used = len(first), np.arange(len(first))
            contexts, over, size = self.hashes(at[first], level), self.total[parent], size[there][first]
        hot = size > self.corpus.often
        h = np.flatnonzero(hot)
        keys = np.concatenate((contexts[~hot], mixed(contexts[h][:, None] ^ (STEP * np.arange(1, SPLIT + 1, dtype=np.uint64))).reshape(-1)))
        order = np.argsort(keys)
        rank, key = np.empty(len(keys), np.int64), np.zeros(count, np.int64)
        rank[order] = np.arange(len(keys))
        key[used[~hot]], key[used[h]] = np.arange(len(used) - len(h)), len(used) - len(h) + SPLIT * np.arange(len(h))
        codes = self.codes[at]
        if len(h):
            several = np.zeros(count, np.int64)
            several[used[h]] = 1
            key = rank[key[which] + several[which] * self.split[codes]]
        else:
            key = rank[key][which] if len(rank) else which
        first, pair, key, _ = paired(key, codes)
        return Asked(at, which, count, used, over, hot, keys, order, pair, first, np.bincount(key, minlength=len(keys)))

    def ask_pairs(self) -> pa.RecordBatch:
        asked = self.asking()
        cold = len(asked.used) - np.count_nonzero(asked.hot)
        over = np.concatenate((asked.over[~asked.hot], np.repeat(asked.over[asked.hot], SPLIT)))[asked.order]
        at = asked.at[asked.first]
        n = np.bincount(asked.pair, ~self.held[asked.at], len(at)).astype(np.int64)
        columns = [over, asked.order >= cold, asked.sizes]
        return by_range(self.row["slice"], asked.keys[asked.order], columns, self.corpus.bits, [self.ids[self.codes[at]], n, self.bound[at]], np.append(0, np.cumsum(asked.sizes)))

    def open(self) -> list[np.ndarray]:
        """Of each level's contexts those that are no states, but may have longer ones that are."""
        return [np.flatnonzero(level.flags == GROWN) for level in self.levels]

    def ask_states(self) -> pa.RecordBatch:
        deepest = np.zeros(len(self.codes), np.int8)
        for k, level in enumerate(self.levels, 1):
            deepest[level.at[(level.flags & STATE != 0)[level.which]]] = k
        keys, known = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for k, (level, some) in enumerate(zip(self.levels, self.open()), 1):
            further = np.zeros(len(level.flags), bool)
            further[level.which[deepest[level.at] > k]] = True
            keys.append(self.contexts(k)[some])
            known.append(further[some])
        keys, known = np.concatenate(keys), np.concatenate(known)
        order = np.argsort(keys)
        return by_range(self.row["slice"], keys[order], [known[order]], self.corpus.bits)

    def tell(self, parts: list[bytes]) -> None:
        """Takes the answers, by ranges of keys, to what it asks of words, if these are not known yet, or of the contexts one longer."""
        if self.level < 0:
            order = np.argsort(self.words)
            columns = np.empty((2, len(order)), np.int64)
            columns[:, order] = together(parts, 2)
            self.count_words(*columns)
            return
        asked = self.asking()
        n, told, code, most, gain = together(parts, 5)
        hot, used = asked.hot, asked.used
        cold = len(used) - np.count_nonzero(hot)
        total, distinct, flags = (np.zeros(asked.count, np.int64) for _ in range(3))
        totals, codes = np.empty(len(asked.keys), np.int64), np.empty(len(asked.keys), np.int64)
        totals[asked.order], codes[asked.order] = told, code
        total[used[~hot]], distinct[used[~hot]], flags[used[~hot]] = totals[:cold], codes[:cold] >> 2, codes[:cold] & 3
        if cold < len(used):
            back = np.argsort(asked.order[asked.order >= cold])
            some = [x.reshape(-1, SPLIT) for x in (totals[cold:], most[back], codes[cold:] >> 2, gain[back])]
            total[used[hot]], distinct[used[hot]] = some[0].sum(axis=1), some[2].sum(axis=1)
            flags[used[hot]] = judged(total[used[hot]], some[1].max(axis=1), distinct[used[hot]], some[3].sum(axis=1), asked.over[hot], self.corpus.cost)
        self.add(Level(asked.at, asked.which, n[asked.pair], total, distinct, flags))

    def add(self, level: Level) -> None:
        self.levels.append(level)
        self.level += 1
        # What isn't asked has a context that occurs once at most, but for those that would begin before their text.
        gone = np.zeros(len(self.codes), bool)
        gone[self.at], gone[level.at] = True, False
        gone = np.flatnonzero(gone & (self.places >= self.level - 1))
        self.bound[gone] = np.minimum(self.bound[gone], LEAST - 1)
        self.bound[level.at] = level.n
        grown = np.flatnonzero((level.flags & GROWN != 0)[level.which])
        self.at, self.which, self.total = level.at[grown], level.which[grown], level.total

    def tell_states(self, parts: list[bytes]) -> None:
        known = together(parts, 1)[0]
        some = self.open()
        keys = np.concatenate([np.zeros(0, np.uint64), *[self.contexts(k)[x] for k, x in enumerate(some, 1)]])
        states = np.empty(len(keys), np.int64)
        states[np.argsort(keys)] = known
        for level, x in zip(self.levels, some):
            level.flags[x] |= states[: len(x)] * STATE
            states = states[len(x) :]

    def whole(self) -> pa.RecordBatch:
        """All that is known."""
        known, none = [packed(self.counts, self.ids)], np.zeros(0, np.int64)
        for k, level in enumerate(self.levels):
            places = (np.diff(level.at, prepend=0), level.which) if k else (none, none)
            known.append(packed(*places, *level[2:]))
        return rows_as(KNOWN, [{"slice": self.row["slice"], "known": known}])

    def rest(self) -> pa.RecordBatch:
        """A row with only the symbols that longer contexts look at, whose answers go on from here."""
        kept = np.zeros(len(self.codes) + 1, np.int64)
        for start, change in ((np.maximum(self.at - self.corpus.depth, 0), 1), (self.at + 1, -1)):
            np.add.at(kept, start, change)
        kept = np.flatnonzero(np.cumsum(kept[:-1]))
        used, codes = np.unique(self.codes[kept], return_inverse=True)
        contexts, which = np.unique(self.which, return_inverse=True)
        start = [np.searchsorted(kept, self.at), which, self.total[contexts], self.bound[kept], self.places[kept], self.held[kept], self.ids[used], np.array([self.level])]
        row = {**self.row, "docs": [], "held": [], "bounds": packed(np.zeros(0, np.int64)), "words": packed(self.words[used], self.own[used]), "codes": packed(codes)}
        return rows_as(RELATION, [{**row, "known": [], "start": [packed(x) for x in start]}])

    def probabilities(self, size: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Each symbol's probability at the root, and with all states that its text so far ends with; and what the next shorter context gives, level by level."""
        root = ((self.counts + 1) / size)[self.codes]
        p, shorter = root.copy(), []
        for level in self.levels:
            shorter.append(p[level.at])
            state = np.flatnonzero((level.flags & STATE != 0)[level.which])
            at, n, which = level.at[state], level.n[state], level.which[state]
            total = np.maximum(level.total, 1)
            p[at] = np.maximum(n - DISCOUNT, 0) / total[which] + (DISCOUNT * level.distinct / total)[which] * p[at]
        return root, p, shorter


def row_of(batch: pa.RecordBatch | pa.Table, i: int) -> dict:
    return {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def summed(parts: list[list[np.ndarray]], bits: int, bucket: int) -> tuple[list[list[np.ndarray]], float]:
    """Each word's count and number, by parts. Numbers are distinct in all ranges, and small for frequent words. And how many words there are to learn from."""
    first, place = grouped(np.concatenate([x[0] for x in parts]).astype(np.uint64))
    total = np.bincount(place, np.concatenate([x[1] for x in parts]), len(first)).astype(np.int64)
    number = np.empty(len(total), np.int64)
    number[np.argsort(-total, kind="stable")] = np.arange(len(total))
    number = (number << bits) | bucket
    edges = np.cumsum([0, *[len(x[0]) for x in parts]])
    return [[total[place[a:b]], number[place[a:b]]] for a, b in zip(edges[:-1], edges[1:])], float(np.count_nonzero(total))


def followed(parts: list[list[np.ndarray]], cost: float) -> tuple[list[list[np.ndarray]], float]:
    """How often each symbol follows its context, and each context's total, distinct symbols and flags, or, for some of those dealt over ranges, what adds up to these;
    by parts. And how many symbols have contexts that may have longer ones."""
    over, hot, sizes, ids, n, above = (np.concatenate([x[i] for x in parts]).astype(np.int64) for i in range(1, 7))
    first, key = grouped(np.concatenate([x[0] for x in parts]).astype(np.uint64))
    over, often, count = over[first], hot[first] > 0, len(first)
    starts, pair, group, _ = paired(np.repeat(key, sizes), ids)
    n, above = np.bincount(pair, n, len(starts)).astype(np.int64), above[starts]
    total = np.bincount(group, n, count).astype(np.int64)
    distinct = np.bincount(group, n > 0, count).astype(np.int64)
    gain = np.bincount(group, n * np.log(np.maximum(n, 1) / np.maximum(above, 1)), count)
    most = np.zeros(count, np.int64)
    begins = np.flatnonzero(np.diff(group, prepend=-1))
    if len(begins):
        most[group[begins]] = np.maximum.reduceat(n, begins)
    flags = judged(total, most, distinct, gain, over, cost)
    flags[often] = 0
    kept = (flags > 0) | often
    total, code = np.where(kept, total, 0), np.where(kept, distinct * 4 + flags, 0)
    n, totals, codes = n[pair], total[key], code[key]
    outer, inner = np.cumsum([0, *[len(x[0]) for x in parts]]), np.cumsum([0, *[len(x[4]) for x in parts]])
    out = []
    for a, b, c, d in zip(outer[:-1], outer[1:], inner[:-1], inner[1:]):
        some = key[a:b][hot[a:b] > 0]
        out.append([*map(small, (n[c:d], totals[a:b], codes[a:b], most[some])), gain[some]])
    return out, float(total[(flags & GROWN != 0) | often].sum())


def followed_by_parts(parts: list[list[np.ndarray]], corpus: Corpus, bucket: int) -> tuple[list[list[np.ndarray]], float]:
    """``followed``, for some of a range's keys at a time."""
    pieces = max(0, (sum(len(x[4]) for x in parts) // PAIRS).bit_length())
    if not pieces or corpus.bits + pieces > 64:
        return followed(parts, corpus.cost)
    edges = (np.uint64(bucket << pieces) + np.arange(1, 1 << pieces, dtype=np.uint64)) << np.uint64(64 - corpus.bits - pieces)
    outer = [[0, *np.searchsorted(x[0], edges).tolist(), len(x[0])] for x in parts]
    inner = [np.append(0, np.cumsum(x[3], dtype=np.int64))[o].tolist() for x, o in zip(parts, outer)]
    out, about = [[] for _ in parts], 0.0
    for k in range(1 << pieces):
        cuts = [[y[o[k] : o[k + 1]] for y in x[:4]] + [y[i[k] : i[k + 1]] for y in x[4:]] for x, o, i in zip(parts, outer, inner)]
        found, more = followed(cuts, corpus.cost) if any(len(x[0]) for x in cuts) else ([], 0.0)
        about += more
        for columns, some in zip(out, found):
            columns.append(some)
    return [[np.concatenate(x) for x in zip(*some)] for some in out], about


def either(parts: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Whether any part says so of a key, by parts."""
    first, place = grouped(np.concatenate([x[0] for x in parts]).astype(np.uint64))
    found = np.bincount(place, np.concatenate([x[1] for x in parts]), len(first)) > 0
    edges = np.cumsum([0, *[len(x[0]) for x in parts]])
    return [[found[place[a:b]]] for a, b in zip(edges[:-1], edges[1:])]


def answered(asked: DataFrame, level: int, corpus: Corpus) -> DataFrame:
    """The answers to ``asked`` (slice, bucket, columns), in its form and order, about words (level 0), pairs of contexts and symbols, or states (level -1).

    Who gets a range of keys adds up what the slices have, and answers each. Neither a frequent word nor a frequent context is more than one key of a slice,
    nor a pair; contexts that many symbols may follow are more than one.
    """

    def answer(asking: pa.Table) -> pa.Table:
        parts = [unpacked(memoryview(x.as_buffer())) for x in asking.column("columns")]
        bucket = asking.column("bucket")[0].as_py()
        if level == 0:
            out, about = summed(parts, corpus.bits, bucket)
        else:
            out, about = (either(parts), 0.0) if level < 0 else followed_by_parts(parts, corpus, bucket)
        columns = [pa.array([packed(*x) for x in out], pa.binary()), pa.array([about, *[0.0] * (len(out) - 1)]), pa.array([level] * len(out), pa.int64())]
        del parts, out
        give_back()
        return pa.table([asking.column("slice"), asking.column("bucket"), *columns], ["slice", "bucket", "columns", "about", "level"])

    partitions = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asked.repartition(partitions, "bucket").groupBy("bucket").applyInArrow(answer, REPLY)


def asked_words(relation: DataFrame, corpus: Corpus) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                words, own = unpacked(batch.column("words")[i].as_py())
                order = np.argsort(words)
                yield by_range(batch.column("slice")[i].as_py(), words[order].astype(np.uint64), [own[order]], corpus.bits)

    return relation.select("slice", "words").mapInArrow(work, MESSAGE)


def told(relation: DataFrame, replies: DataFrame, level: int, work: Callable[[Slice], pa.RecordBatch], schema: str, corpus: Corpus, states: bool = False) -> DataFrame:
    """What ``work`` makes of each slice, brought by ``replies`` to contexts of length ``level``, and with the ``states`` if these are known."""

    def take(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Slice(row_of(left, 0), corpus)
        right = right.sort_by("bucket")
        of = right.column("level").to_numpy()
        for k in range(own.level + 1, level + 1):
            own.tell(right.filter(pa.array(of == k)).column("columns").to_pylist())
        if states:
            own.tell_states(right.filter(pa.array(of == -1)).column("columns").to_pylist())
        out = work(own)
        del own
        give_back()
        return pa.Table.from_batches([out])

    partitions = int(relation.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    right = replies.select("slice", "bucket", "columns", "level").repartition(partitions, "slice")
    # The relation is bucketed by its slices.
    return relation.groupBy("slice").cogroup(right.groupBy("slice")).applyInArrow(take, schema)


class Learnt(NamedTuple):
    """A relation, all answers, and the folder of both."""

    relation: DataFrame
    replies: DataFrame
    folder: str
    corpus: Corpus
    distinct: int

    def read(self, work: Callable[[Slice], pa.RecordBatch], schema: str) -> DataFrame:
        """What ``work`` makes of each slice, all of whose states are known."""
        return told(self.relation, self.replies, self.corpus.depth, work, schema, self.corpus, states=True)


def learnt(texts: DataFrame) -> Learnt:
    """What there is to know of ``texts`` (doc_id, text, held_out) for their scores, learnt from those not held out.

    Contexts are counted length by length, as long as some may be states, and up to half the natural logarithm of the number of tokens. The slices are written
    once, and each length's answers beside them, from which slices are brought to that length again; behind REPLAYED lengths they are written with all that is known.
    """
    spark = texts.sparkSession
    small_batches(spark)
    folder = shared_folder(spark, "suffix-tree")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def stored(made: Callable[[], DataFrame], name: str, bucketed: bool = False) -> DataFrame:
        df = made()
        schema = df.schema
        # Each is computed once, so Spark may delete what it shuffled at its end.
        clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        had = spark.conf.get(clean, None)
        spark.conf.set(clean, "true")
        table = f"tributary_slices_{uuid.uuid4().hex}"
        writer = df.write.option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", "false").option("compression", "zstd")
        if bucketed:
            writer.bucketBy(partitions, "slice").option("path", f"{folder}/{name}").saveAsTable(table)
        else:
            writer.parquet(f"{folder}/{name}")
        spark.conf.unset(clean) if had is None else spark.conf.set(clean, had)
        # What was shuffled for it otherwise is deleted once neither Python nor the driver's JVM knows of the plan; Python tells the JVM once a second.
        del df, writer, made
        gc.collect()
        if size >= WAITED:
            time.sleep(1.5)
        for _ in range(2):
            spark.sparkContext._jvm.System.gc()
        if not bucketed:
            return spark.read.schema(schema).parquet(f"{folder}/{name}")
        found = spark.table(table)
        spark.sql(f"DROP TABLE {table}")  # its files stay
        return found

    def replies(names: list[str]) -> DataFrame:
        return spark.read.schema(REPLY).parquet(*[f"{folder}/{name}" for name in names])

    def taken(names: list[str]) -> DataFrame:
        return replies(names) if names else spark.createDataFrame([], REPLY)

    def about(name: str) -> float:
        return replies([name]).agg(F.coalesce(F.sum("about"), F.lit(0.0))).first()[0]

    relation = stored(lambda: relation_of(texts).repartition(partitions, "slice"), "slices", bucketed=True)
    tokens, numbers = (int(x) for x in relation.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("tokens", "texts")]).first())
    corpus = Corpus(tokens, numbers, max(2, int(math.log(max(1, tokens)) / 2)), 0).ranged(size)
    stored(lambda: answered(asked_words(relation, corpus), 0, corpus), "words")
    distinct, known = about("words"), ["words"]
    part, names, grown = relation, known, tokens  # what goes on, and the answers it has yet to take
    for k in range(1, corpus.depth + 1):
        ranges = corpus.ranged(size * grown / max(1, tokens))
        stored(lambda: answered(told(part, taken(names), k - 1, Slice.ask_pairs, MESSAGE, ranges), k, ranges), f"pairs-{k}")
        names = [*names, f"pairs-{k}"]
        known = names if part is relation else [*known, f"pairs-{k}"]
        grown = about(f"pairs-{k}")
        if not grown:
            break
        if k == REPLAYED and k < corpus.depth and part is relation:
            more = stored(lambda: told(relation, replies(known), k, Slice.whole, KNOWN, corpus), "known", bucketed=True)
            for name in known:
                drop_folder(spark, f"{folder}/{name}")
            part = relation.drop("known").join(more.hint("merge"), "slice").select(*relation.columns)
            relation, known, names = part, [], []
        if part is relation and k < corpus.depth and FEW * grown <= tokens:
            # Few symbols are left: they go on without the others.
            part, names = stored(lambda: rest_of(relation, taken(known), k, corpus), "rest", bucketed=True), []
    corpus = corpus._replace(depth=k).ranged(size / 16)  # the levels that have answers; contexts to ask about are few
    stored(lambda: answered(told(relation, taken(known), k, Slice.ask_states, MESSAGE, corpus), -1, corpus), "states")
    return Learnt(relation, replies([*known, "states"]), folder, corpus, int(distinct))


def rest_of(relation: DataFrame, replies: DataFrame, level: int, corpus: Corpus) -> DataFrame:
    """The rows with only what longer contexts than those known need."""
    return told(relation, replies, level, Slice.rest, RELATION, corpus)


def fit(train: DataFrame) -> tuple[Tree, DataFrame, str]:
    """The tree learnt from all of ``train`` (text), the table (key, last, n) of its words' counts, and the folder that holds what the tree is read from."""
    spark = train.sparkSession
    every = train.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("held_out"))
    known = learnt(every)
    folder, tokens, distinct = known.folder, known.corpus.tokens, known.distinct
    path = f"{folder}/word-counts"
    word_counts(train).write.parquet(path)
    words = spark.read.parquet(path)
    lookup, counts = frequent(words, max(1, LOOKUP_SHARE * tokens))
    size = tokens + distinct + 1

    def work(own: Slice) -> pa.RecordBatch:
        found = []
        for k, (level, q) in enumerate(zip(own.levels, own.probabilities(size)[2]), 1):
            s = np.flatnonzero((level.flags & STATE != 0)[level.which])
            which = level.which[s]
            left = DISCOUNT * level.distinct[which] / level.total[which]
            p = (level.n[s] - DISCOUNT) / level.total[which] + left * q[s]
            contexts = own.contexts(k)[which]
            keys = np.concatenate((contexts, contexts ^ own.words[own.codes[level.at[s]]]))
            v = np.concatenate((np.log10(left), np.log10(p / q[s]) - np.log10(left)))
            keys, first = np.unique(keys, return_index=True)
            found.append((signed(keys), v[first], np.where(first < len(s), k, 0)))
        return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found)], ["key", "v", "depth"])

    values = known.read(work, "key long, v double, depth long").groupBy("key").agg(F.max("v").alias("v"), F.max("depth").alias("depth"))
    own = values.where("depth = 1").select("key", "v")
    often = spark.createDataFrame(pa.table([pa.array(signed(mixed(lookup)))], ["key"]))
    held = own.join(often, "key").toArrow()
    keys = held.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    at, there = find(keys[order], mixed(lookup))
    weights = np.where(there, 10 ** held.column("v").to_numpy()[order][at], 1.0) if len(keys) else np.ones(len(lookup))
    sent = States(known.corpus.depth, np.concatenate((np.ones(FIRST_WORD), weights)))
    return Tree(sent, values.select("key", "v"), lookup, counts, known.corpus.texts, tokens, distinct), words, folder


def held_out(doc_id: str = "doc_id", parts: int = 7, part: int = 2):
    """Whether crc32 of the id as text, null as the empty text, leaves ``part`` when divided by ``parts``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    Tokens are the lower-cased words and one end; null texts are empty. Learnt from the rows that are not held out. The root gives a token
    (count + 1) / (tokens + distinct tokens + 1), which base_score sums. score takes the longest suffix of the text so far that is a state; each state
    has its discounted shares, and leaves the rest to the next shorter one. Words and contexts are known by 64-bit hashes; texts learn the counts and
    states of theirs from the ranges of hashes that have them, so no executor holds the tree. Rows that repeat an id or a text keep their rows; other
    columns are not read; an empty table gives none.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", held_out())
    known = learnt(texts)
    size = known.corpus.tokens + known.distinct + 1

    def work(own: Slice) -> pa.RecordBatch:
        root, p, _ = own.probabilities(size)
        columns = [np.diff(own.bounds), sums((own.counts > 0).astype(np.int64)[own.codes], own.bounds), sums(np.log10(root), own.bounds), sums(np.log10(p), own.bounds)]
        ids = [pa.array(own.row["docs"], pa.int64()), pa.array(own.row["held"], pa.bool_())]
        return pa.record_batch([*ids, *[pa.array(x) for x in columns]], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    rows = known.read(work, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    result = cut(rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.corpus.tokens).cast("long").alias("train_tokens"), "base_score", "score"))
    drop_folder(docs.sparkSession, known.folder)
    return result
