"""A linear-chain conditional random field over word shapes: training on a small table, decoding in numpy batches."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: 0 is outside; 2k + 1 begins kind k, 2k + 2 goes on with it.
LABELS = 1 + 2 * len(KINDS)
#: Words without digits, "@" or "+" that may be part of personal data.
SPOKEN = ("at", "dot", "(at)", "[at]", "(dot)", "[dot]")
PLAIN = "plain"
MARKS = ".,;:!?\"'>]"


def shape_features(word: str) -> tuple[str, ...]:
    """What the model sees of a word: its shape, runs of digits by length, and a few tests. All words that can't be part of personal data by
    themselves have one shape."""
    word = word.rstrip(MARKS).lstrip("\"'<[") or word
    low = word.lower()
    if low in SPOKEN or low in ("(at", "(dot", "at)", "dot)"):
        return ("spoken-" + low.strip("([])"),)
    if not re.search(r"[0-9@+]", word):
        return (PLAIN,)
    digits = sum(c.isdigit() for c in word)
    shape = re.sub(r"[^\W\d_]+", "a", word)
    shape = re.sub(r"[0-9]+", lambda m: f"d{len(m[0])}" if len(m[0]) < 5 else "d5-12" if len(m[0]) < 13 else "d13-19" if len(m[0]) < 20 else "d20", shape)
    coarse = re.sub(r"d[0-9-]+", "d", shape)
    size = digits if digits < 5 else 5 if digits < 10 else 10 if digits < 13 else 13 if digits < 16 else 16 if digits < 20 else 20
    found = [f"shape={shape[:24]}", f"coarse={coarse[:16]}", f"digits={size}", f"first={word[0] if not word[0].isalnum() else coarse[0]}"]
    if "@" in word:
        found.append("has-at")
    if re.search("[A-Za-z]", word):
        found.append("has-letter")
    if re.fullmatch(r"[0-9]{1,3}(\[?\.\]?[0-9]{1,3}){3}", word):
        found.append("dotted-four")
    if re.fullmatch(r"[0-9().+/-]+", word):
        found.append("numeric")
    return tuple(found)


class Model(NamedTuple):
    """``weights[role][feature]`` is a row of label weights; roles are the word before, the word itself, the word after."""

    names: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def rows(self, words: list[str]) -> np.ndarray:
        """For each distinct word its part in the label weights of its three roles."""
        out = np.zeros((len(words), 3, LABELS))
        for i, word in enumerate(words):
            at = [self.names[f] for f in shape_features(word) if f in self.names]
            out[i] = self.weights[:, at].sum(axis=1)
        return out


def labelled_table() -> list[list[tuple[str, int]]]:
    """Sentences of words with labels, made by rule: usual and unusual spellings of each kind among plain words, and numbers that are none."""
    rng = np.random.default_rng(11)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(3, 9))))
    byte = lambda: str(rng.integers(1, 256))
    four = [digits(4) for _ in range(4)]

    def spellings() -> list[tuple[str, int]]:
        a, b, c = digits(3), digits(3), digits(4)
        four[:] = ["4" + digits(3), digits(4), digits(4), digits(4)]
        host = f"{name()}.{['com', 'org', 'net', 'example.com'][rng.integers(4)]}"
        spoken = [("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]")][rng.integers(3)]
        return [
            (f"{name()}.{digits(2)}@{host}", 0), (f"{name()}@{host}", 0), (f"{name()} {spoken[0]} {name()} {spoken[1]} com", 0), (f"{name()} @ {host}", 0),
            (".".join([byte() for _ in range(4)]), 1), ("[.]".join([byte() for _ in range(4)]), 1),
            ("".join(four), 2), (" ".join(four), 2), ("-".join(four), 2), (".".join(four), 2), ("/".join(four), 2),
            (f"+1 ({a}) {b}-{c}", 3), (f"({a}) {b}-{c}", 3), (f"+{digits(2)} {a} {b}{c}", 3), (f"{a}-{b}-{c}", 3), (f"{a}.{b}.{c}", 3), (f"+{digits(11)}", 3),
        ]

    def others() -> list[str]:
        return [
            f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}", digits(12), digits(int(rng.integers(1, 7))), f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}",
            f"password={digits(6)}{name()}{digits(5)}", f"{name()}{digits(3)}{name()}{digits(9)}", f"${digits(3)}", f"{digits(2)}%", f"at {name()}", f"{name()} at", "at the", f"dot {name()}", digits(24), f"@{name()}",
        ]

    table = []
    for _ in range(40):
        for text, kind in [*spellings(), *((x, None) for x in others())]:
            before, after = ([(name(), 0) for _ in range(rng.integers(1, 5))] for _ in range(2))
            words = text.split(" ")
            if rng.integers(3) == 0:
                words[-1] += "."
            inside = [(w, 0 if kind is None else 2 * kind + (1 if i == 0 else 2)) for i, w in enumerate(words)]
            table.append([*before, *inside, *after])
    return table


def train(table: list[list[tuple[str, int]]], steps: int = 120) -> Model:
    """Weights of greatest likelihood, with a small penalty, by forward-backward sums over all sentences at once."""
    names: dict[str, int] = {}
    for sentence in table:
        for word, _ in sentence:
            for f in shape_features(word):
                names.setdefault(f, len(names))
    length, count = max(map(len, table)), len(table)
    at = np.zeros((count, length, len(names)))
    gold, there = np.zeros((count, length), int), np.zeros((count, length), bool)
    for i, sentence in enumerate(table):
        for t, (word, label) in enumerate(sentence):
            at[i, t, [names[f] for f in shape_features(word)]] = 1
            gold[i, t], there[i, t] = label, True
    plain = at[..., names[PLAIN]]
    plain[~there] = 1
    roles = np.stack([np.concatenate((np.zeros_like(at[:, :1]), at[:, :-1]), 1), at, np.concatenate((at[:, 1:], np.zeros_like(at[:, :1])), 1)])
    roles[0, :, 0, names[PLAIN]] = roles[2, :, -1, names[PLAIN]] = 1
    flat = roles.transpose(1, 2, 0, 3).reshape(count * length, -1)
    truth = np.eye(LABELS)[gold]
    weights, moves = np.zeros((flat.shape[1], LABELS)), np.zeros((LABELS, LABELS))
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    for step in range(1, steps + 1):
        score = (flat @ weights).reshape(count, length, LABELS)
        e, m = np.exp(score - score.max(axis=2, keepdims=True)), np.exp(moves)
        forward, backward = np.zeros_like(e), np.ones_like(e)
        forward[:, 0] = e[:, 0] * m[0]
        for t in range(length):
            if t:
                forward[:, t] = forward[:, t - 1] @ m * e[:, t]
            forward[:, t] /= forward[:, t].sum(axis=1, keepdims=True)
        backward[:, -1] = m[:, 0]
        for t in range(length - 2, -1, -1):
            backward[:, t] = (backward[:, t + 1] * e[:, t + 1]) @ m.T
            backward[:, t] /= backward[:, t].sum(axis=1, keepdims=True)
        p = forward * backward
        p /= p.sum(axis=2, keepdims=True)
        pair = forward[:, :-1, :, None] * m[None, None] * (e * backward)[:, 1:, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        slope_w = flat.T @ (truth - p).reshape(-1, LABELS) / count - 1e-4 * weights
        slope_m = (np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:]) - pair.sum(axis=(0, 1))) / count - 1e-4 * moves
        for k, (x, slope) in enumerate(((weights, slope_w), (moves, slope_m))):
            first, second = state[2 * k], state[2 * k + 1]
            first += 0.1 * (slope - first)
            second += 0.001 * (slope**2 - second)
            x += 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    # A step can only go on with what it follows.
    for label in range(2, LABELS, 2):
        moves[[x for x in range(LABELS) if x not in (label, label - 1)], label] = -1e3
    return Model(names, weights.reshape(3, len(names), LABELS), moves)


def viterbi(score: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels of each sequence ``bounds[i]:bounds[i + 1]``, all sequences a step at a time; outside before and after each."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    start, sizes = bounds[:-1][order], sizes[order]
    out = np.zeros(len(score), np.int64)
    if not len(sizes) or not sizes[0]:
        return out
    back = np.zeros((len(score), LABELS), np.int8)
    best = np.zeros((len(sizes), LABELS))
    for t in range(sizes[0]):
        n = int(np.searchsorted(-sizes, -t, "left"))  # sequences longer than t
        if t:
            paths = best[:n, :, None] + moves
            back[start[:n] + t] = paths.argmax(axis=1)
            best[:n] = paths.max(axis=1) + score[start[:n] + t]
        else:
            best[:n] = moves[0] + score[start[:n]]
    label = (best + moves[:, 0]).argmax(axis=1)
    for t in range(sizes[0] - 1, -1, -1):
        n = int(np.searchsorted(-sizes, -t, "left"))
        out[start[:n] + t] = label[:n]
        label[:n] = back[start[:n] + t, label[:n]]
    return out
