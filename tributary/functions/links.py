"""Link conditions between a detail table ("sub") and the current table ("main").

Text links ignore case and take the main value literally. Null on either side never links.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import values as V
from tributary.functions.names import bare, col
from tributary.functions.predicates import ORDERING, all_of, any_of, is_group

SUB, MAIN = "sub", "main"
TEXT_LINKS = ("contains", "starts_with", "ends_with")
FLIPPED = {"=": "=", "!=": "!=", ">": "<", ">=": "<=", "<": ">", "<=": ">="}


@dataclass(frozen=True)
class Link:
    """``sub.field <op> main.main_field``"""

    field: str
    op: str
    main_field: str

    def column(self, subs: T.StructType, mains: T.StructType) -> Column:
        s_type, m_type = V.field_type(subs, self.field), V.field_type(mains, self.main_field)
        return link_test(col(self.field, SUB), s_type, self.op, col(self.main_field, MAIN), m_type)


def link_test(s: Column, s_type: T.DataType, op: str, m: Column, m_type: T.DataType) -> Column:
    if op in TEXT_LINKS or op == "not_contains":
        a, b = F.lower(V.text_of(s, s_type)), F.lower(V.text_of(m, m_type))
        match op:
            case "contains":
                return F.contains(a, b)
            case "not_contains":
                return ~F.contains(a, b)
            case "starts_with":
                return F.startswith(a, b)
            case "ends_with":
                return F.endswith(a, b)
    a, b = V.aligned(s, s_type, m, m_type)
    if op == "=":
        return a == b
    return a != b if op == "!=" else ORDERING[op](a, b)


@dataclass(frozen=True)
class Own:
    """A test on the sub row alone."""

    test: Column = field(compare=False)


@dataclass(frozen=True)
class Text:
    """Free condition text over ``sub.`` and ``main.``; Spark parses it."""

    text: str


@dataclass(frozen=True)
class Node:
    """AND / OR over links, own tests, texts and nodes."""

    op: str
    items: tuple

    def column(self, subs: T.StructType, mains: T.StructType) -> Column:
        tests = [term_column(i, subs, mains) for i in self.items]
        return all_of(tests) if self.op == "AND" else any_of(tests)


def term_column(term, subs: T.StructType, mains: T.StructType) -> Column:
    if isinstance(term, Own):
        return term.test
    if isinstance(term, Text):
        return F.expr(term.text)
    return term.column(subs, mains)


def link_tree(tree: Mapping[str, Any] | None, subs: T.StructType, mains: T.StructType) -> Node:
    """Link-condition record to a tree. Conditions that name no field say nothing and are left out."""
    items = []
    for item in (tree or {}).get("conditions") or []:
        if not isinstance(item, Mapping):
            continue
        term = link_tree(item, subs, mains) if is_group(item) else _term(item, subs, mains)
        if term is not None and not (isinstance(term, Node) and not term.items):
            items.append(term)
    word = str((tree or {}).get("logicalOperator", "AND")).upper()
    return Node("OR" if word == "OR" else "AND", tuple(items))


def _term(item: Mapping[str, Any], subs: T.StructType, mains: T.StructType):
    op = str(item.get("operator") or "=").strip().lower()
    if op in ("always_true", "always_false"):
        return Own(F.lit(op == "always_true"))
    name = bare(str(item.get("field") or ""))
    if not name:
        return None
    _require(name, subs, "sub")
    cell, text = col(name, SUB), V.text_column(subs, name, SUB)
    match op:
        case "is_null":
            return Own(cell.isNull())
        case "is_not_null":
            return Own(cell.isNotNull())
        case "is_empty":
            return Own(cell.isNull() | (text == ""))
        case "is_not_empty":
            return Own(cell.isNotNull() & (text != ""))
    main_name = bare(str(item.get("mainField") or item.get("value") or ""))
    if not main_name:
        return None
    _require(main_name, mains, "main")
    if not (op in FLIPPED or op in TEXT_LINKS or op == "not_contains"):
        raise ValueError(f"unknown link operator '{op}' on '{name}'")
    return Link(name, op, main_name)


def _require(name: str, schema: T.StructType, side: str) -> None:
    if name not in schema.fieldNames():
        raise ValueError(f"{side} table has no column '{name}'; columns are {schema.fieldNames()}")


_NAME = r"[A-Za-z_][\w-]*|`[^`]+`|\"[^\"]+\""
_TERM = re.compile(rf"\s*(?:({_NAME})\s*\.\s*)?({_NAME})\s*(>=|<=|!=|<>|=|>|<)\s*(?:({_NAME})\s*\.\s*)?({_NAME})\s*$")


def plain_comparisons(text: str) -> list[tuple[str | None, str, str, str | None, str]] | None:
    """``a.x = b.y AND ...`` as (prefix, column, op, prefix, column) records; None for any other
    text, which is then handed to Spark's parser whole."""
    out = []
    for piece in re.split(r"\s+AND\s+", text.strip(), flags=re.IGNORECASE):
        found = _TERM.match(piece)
        if not found:
            return None
        lp, lc, op, rp, rc = found.groups()
        if {lc.lower(), rc.lower()} & {"true", "false", "null"}:
            return None
        strip = lambda s: s.strip('`"') if s else None
        out.append((strip(lp), strip(lc), "!=" if op == "<>" else op, strip(rp), strip(rc)))
    return out


_TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|[A-Za-z_][\w]*|[()]|\s+|.", re.DOTALL)


def conjuncts(text: str) -> list[str] | None:
    """The parts that must all hold, cut at each AND that is in no bracket, quote or BETWEEN; None if OR stands among them."""
    parts, depth, between = [""], 0, 0
    for token in _TOKEN.findall(text):
        word = token.upper()
        depth += (token == "(") - (token == ")") + (word == "CASE") - (word == "END")
        if depth == 0 and word == "OR":
            return None
        if depth == 0 and word == "BETWEEN":
            between += 1
        if depth == 0 and word == "AND":
            if not between:
                parts.append("")
                continue
            between -= 1
        parts[-1] += token
    return [p.strip() for p in parts]


def requalify(text: str, names: Mapping[str, str]) -> str:
    """Replace table prefixes (``orders.x`` -> ``main.x``) outside quoted text."""
    pieces = re.split(r"('(?:[^']|'')*')", text)

    def swap(found: re.Match) -> str:
        plain = found[1].strip('`"')
        return f"{names[plain]}." if plain in names else found[0]

    prefix = re.compile(rf"(?<![\w.`\"])({_NAME})\s*\.")
    return "".join(p if p.startswith("'") else prefix.sub(swap, p) for p in pieces)


def on_text(text: str | None, subs: T.StructType, mains: T.StructType, names: Mapping[str, str]) -> Node:
    """ON text to a tree. ``names`` maps table names and aliases to ``sub`` / ``main``."""
    if not text or not text.strip() or text.replace(" ", "") == "1=1":
        return Node("AND", ())
    sides = {SUB: SUB, MAIN: MAIN, **names}
    plain = plain_comparisons(text)
    if plain is None:
        pieces = conjuncts(text) or []
        if len(pieces) > 1:
            return Node("AND", tuple(on_text(piece, subs, mains, names) for piece in pieces))
        return Node("AND", (Text(requalify(text, sides)),))
    links = []
    for lp, lc, op, rp, rc in plain:
        left, right = _side(lp, lc, sides, subs, mains), _side(rp, rc, sides, subs, mains)
        if left == right:
            if lp or rp:
                return Node("AND", (Text(requalify(text, sides)),))
            left = SUB if lc in subs.fieldNames() and rc in mains.fieldNames() else MAIN
        s, m, o = (lc, rc, op) if left == SUB else (rc, lc, FLIPPED[op])
        _require(s, subs, "sub")
        _require(m, mains, "main")
        links.append(Link(s, o, m))
    return Node("AND", tuple(links))


def _side(prefix: str | None, column: str, sides: Mapping[str, str], subs: T.StructType, mains: T.StructType) -> str:
    if prefix:
        if prefix not in sides:
            raise ValueError(f"unknown table '{prefix}' in the link condition")
        return sides[prefix]
    return SUB if column in subs.fieldNames() and column not in mains.fieldNames() else MAIN
