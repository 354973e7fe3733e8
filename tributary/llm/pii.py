"""Personal data: patterns with checks, and a conditional random field for spellings they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm import crf
from tributary.llm.crf import KINDS, MARKS, PLAIN, SPOKEN
from tributary.llm.text import IS_SPACE, LOWER, leaving_nothing, memo, range_hashes, raw, slices, small_batches, word_starts

Span = tuple[int, int]
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits unless it could at the run's start, so long runs are looked at once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
TELLING = np.zeros(256, bool)
TELLING[list(b"0123456789@+")] = True
#: Words decoded on each side of one that may be personal data; beyond them all are outside.
AROUND = 2


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, done))
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    """The patterns' spans by kind, failing matches dropped."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    found["email"] = emails(text)
    found["ip"] = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x[-4:]) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def plausible(kind: str, text: str) -> bool:
    """Whether a decoded span can be what its label says."""
    numbers = re.findall("[0-9]+", text)
    digits = "".join(numbers)
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+ ?@ ?[\w-]+(\.[\w-]+)+|[\w.%+-]+ [(\[]?at[)\]]? (?!(?:the|a|an|this|that)\b)[\w-]+( [(\[]?dot[)\]]? [\w-]+)+", text, re.I))
    if re.search(r"[^\W\d]", text):
        return False
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) < 4 and int(x) <= 255 for x in numbers)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and len(numbers) > 1


SPOKEN_BYTES = sorted({(w + m).encode() for w in (*SPOKEN, "(at", "at)", "(dot", "dot)") for m in ("", *MARKS)})


def spoken_hashes() -> np.ndarray:
    ends = np.cumsum([len(x) for x in SPOKEN_BYTES])
    return range_hashes(np.frombuffer(b"".join(SPOKEN_BYTES), np.uint8), np.concatenate(([0], ends[:-1])), ends)


class Decoder:
    """Spans that the field finds in a batch of texts."""

    def __init__(self, model: crf.Model) -> None:
        self.model, self.spoken = model, spoken_hashes()
        self.rows = memo("crf-rows")
        plain = model.weights[:, [model.names[PLAIN]]].sum(axis=1)
        self.plain = plain

    def part(self, word: bytes) -> np.ndarray:
        found = self.rows.get(word)
        if found is None:
            found = self.model.rows([word.decode(errors="replace")])[0]
            if len(self.rows) < 100_000:
                self.rows[word] = found
        return found

    def spans(self, offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
        """(row, kind, first byte, byte after the last), not yet checked."""
        starts = word_starts(offsets, data)
        if not len(starts):
            return
        keep = ~IS_SPACE[data]
        row = np.searchsorted(offsets, starts, "right") - 1
        limit = np.minimum(np.append(starts[1:], len(data)), offsets[row + 1])
        length = np.add.reduceat(keep, starts) if len(starts) else starts
        ends = np.minimum(starts + length, limit)
        told = np.concatenate(([0], np.cumsum(TELLING[data])))
        special = told[ends] > told[starts]
        short = np.flatnonzero((ends - starts <= 8) & ~special)
        special[short] = np.isin(range_hashes(LOWER[data], starts[short], ends[short]), self.spoken)
        near = special.copy()
        for k in range(1, AROUND + 1):
            near[k:] |= special[:-k] & (row[k:] == row[:-k])
            near[:-k] |= special[k:] & (row[k:] == row[:-k])
        at = np.flatnonzero(near)
        if not len(at):
            return
        parts = np.tile(self.plain, (len(at), 1, 1))
        whole = data.tobytes()
        for i in np.flatnonzero(special[at]).tolist():
            parts[i] = self.part(whole[starts[at[i]] : ends[at[i]]])
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])
        bounds = np.append(np.flatnonzero(fresh), len(at))
        before, after = np.roll(parts[:, 0], 1, axis=0), np.roll(parts[:, 2], -1, axis=0)
        before[bounds[:-1]], after[bounds[1:] - 1] = self.plain[0], self.plain[2]
        labels = crf.viterbi(before + parts[:, 1] + after, bounds, self.model.moves)
        for i in np.flatnonzero((labels > 0) & (labels % 2 == 1)).tolist():
            j = i + 1
            while j < len(at) and not fresh[j] and labels[j] == labels[i] + 1:
                j += 1
            yield int(row[at[i]]), KINDS[(labels[i] - 1) // 2], int(starts[at[i]]), int(ends[at[j - 1]])


def added(decoder: Decoder, array: pa.Array, base: list[dict[str, list[Span]]]) -> list[dict[str, list[Span]]]:
    """The field's plausible spans beside ``base``, in code points, none of which overlaps a base span."""
    offsets, data = raw(array)
    found: list[dict[str, list[Span]]] = [{} for _ in base]
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    whole = data.tobytes()
    for row, kind, a, b in decoder.spans(offsets, data):
        text = whole[a:b].decode()
        left = len(text) - len(text.lstrip("\"'<["))
        text = text[left:].rstrip(MARKS)
        if text.endswith(")") and text.count("(") < text.count(")"):
            text = text[:-1]
        if not plausible(kind, text):
            continue
        start = int(points[a] - points[offsets[row]]) + left
        end = start + len(text)
        if not any(s < end and start < e for spans in base[row].values() for s, e in spans):
            found[row].setdefault(kind, []).append((start, end))
    return found


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans.get(kind, ())))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): n_email, n_ip, n_card, n_phone of the patterns, base_sha256 of their list, and spans: theirs and
    the field's, as kind:start:end in code points.

    Each row is looked at by itself, so repeated rows and ids have equal results. Null and empty texts have no spans. Other columns are not
    read; an empty table gives none. The field is trained on a small table made by rule, in a few seconds on the driver.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(crf.train(crf.labelled_table())))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(crf.Model(*shared.value))
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                base = [base_spans(t) for t in texts]
                more = added(decoder, part.column("text"), base)
                both = [{k: b[k] + m.get(k, []) for k in KINDS} for b, m in zip(base, more)]
                columns = [pa.array([len(b[k]) for b in base], pa.int64()) for k in KINDS]
                digest = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base])
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), *columns, digest, pa.array([listed(b) for b in both])], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(leaving_nothing(work), SCHEMA)


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each piece of personal data replaced by its kind in brackets, and n_chars, if there, counted anew. Null texts stay null."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(crf.train(crf.labelled_table())))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(crf.Model(*shared.value))
        for batch in batches:
            missing = batch.column("text").is_null()
            done = 0
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                base = [base_spans(t) for t in texts]
                out = []
                for text, own, more in zip(texts, base, added(decoder, part.column("text"), base)):
                    spans = sorted((a, b, k) for x in (own, more) for k in KINDS for a, b in x.get(k, ()))
                    pieces, end = [], 0
                    for a, b, kind in spans:
                        if a >= end:
                            pieces += [text[end:a], f"[{kind.upper()}]"]
                        end = max(end, b)
                    out.append("".join(pieces) + text[end:])
                out = [None if gone else x for x, gone in zip(out, missing.slice(done, len(part)).to_pylist())]
                done += len(part)
                yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    found = docs.mapInArrow(leaving_nothing(work), docs.schema)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return found
