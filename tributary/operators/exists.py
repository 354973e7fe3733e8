"""EXISTS sub-views: the rows of a detail table that some row of the current table links to.

The work is shaped so that Spark can hash it. The condition is taken apart at its ORs. In each branch, equality links become the keys of a
semi join whose main side is first cut down: to its distinct keys, to one minimum and maximum per key for a single comparison, or for two
to the steps of ``best_bounds``. A lone text link is decided by ``text_match``. Branches that need one row per key share
a join. Only three and more comparisons, and comparisons beside text links, meet every distinct main value of their key.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import values as V
from tributary.functions.links import (
    MAIN,
    SUB,
    TEXT_LINKS,
    Link,
    Node,
    Own,
    Text,
    link_tree,
    link_test,
    on_text,
    term_column,
)
from tributary.functions.names import col, unique
from tributary.functions.predicates import ORDERING, all_of, any_of, filled
from tributary.functions.sizing import fits_broadcast, known_large
from tributary.operators.band import best_bounds, on_axis
from tributary.operators.text_match import lacking, text_matches

#: Taking ORs apart must not make more branches than this.
MOST_BRANCHES = 32


def exists(
    sub: DataFrame,
    main: DataFrame,
    on: str | None = None,
    tree: Mapping[str, Any] | None = None,
    sub_names: Sequence[str] = (),
    main_names: Sequence[str] = (),
) -> DataFrame:
    """``SELECT sub.* FROM sub WHERE EXISTS (SELECT 1 FROM main WHERE on AND tree)``. With neither,
    every sub row when main has any row."""
    terms = link_terms(sub, main, on, tree, sub_names, main_names)
    columns = sub.columns
    if any(isinstance(t, Text) for t in terms):
        if not any(map(_is_equality, terms)) and known_large(sub) and known_large(main) and not any(_may_equal(t) for t in terms if isinstance(t, Text)):
            raise ValueError("EXISTS without an equality between tables that are too large to broadcast: give an equality")
        return _semi(sub, main, terms).select(*[col(c) for c in columns])
    branches = _branches(terms)
    if len(branches) > MOST_BRANCHES:
        return _semi(sub, main, terms).select(*[col(c) for c in columns])
    if len(branches) == 1:
        own, links = branches[0]
        kept = sub.alias(SUB).where(all_of(own))
        return _keep(kept, main, links).select(*[col(c) for c in columns])
    out = _flagged(sub, main, branches)
    tests = [all_of(own) & col(_hit(i), SUB) for i, (own, _) in enumerate(branches)]
    return out.alias(SUB).where(any_of(tests)).select(*[col(c) for c in columns])


def _may_equal(text: Text) -> bool:
    """Whether Spark may find keys in a text by itself."""
    return "=" in re.sub("[<>!]=", "", text.text)


def _hit(branch: int) -> str:
    return f"__hit{branch}"


def _flagged(sub: DataFrame, main: DataFrame, branches: Sequence) -> DataFrame:
    """``sub`` with a column for each branch: whether some main row satisfies its links. Branches with equal keys and at most one bound are one join
    to one row per key."""
    out, shared = sub, {}
    for i, (_, links) in enumerate(branches):
        keys, rest = tuple(k for k in links if _is_equality(k)), [k for k in links if not _is_equality(k)]
        if all(_comparable(k, sub, main) for k in links) and len(rest) <= 1 and all(k.op in _BOUND for k in rest):
            shared.setdefault(keys, []).append((i, rest))
        elif links:
            fields = unique(link.field for link in links)
            values = sub.select(*[col(f) for f in fields]).where(filled(sub.schema, fields)).distinct()
            found = _keep(values, main, links).select(*[col(f).alias(f"{_hit(i)}_{j}") for j, f in enumerate(fields)], F.lit(True).alias(_hit(i)))
            test = all_of(col(f, SUB) == F.col(f"{_hit(i)}_{j}") for j, f in enumerate(fields))
            joined = out.alias(SUB).join(found.alias(MAIN), test, "left")
            out = joined.select(*[col(c, SUB) for c in out.columns], F.col(f"{MAIN}.{_hit(i)}").isNotNull().alias(_hit(i)))
    for keys, group in shared.items():
        bounds = [b for i, rest in group for link in rest for b in _bounds(link, main, i)]
        if keys:
            needed = main.groupBy(*[col(n) for n in unique(k.main_field for k in keys)])
            needed = needed.agg(F.lit(True).alias("__here"), *bounds)
        else:
            needed = F.broadcast(main.agg((F.count(F.lit(1)) > 0).alias("__here"), *bounds))  # one row
        test = all_of(k.column(sub.schema, main.schema) for k in keys)
        joined = out.alias(SUB).join(needed.alias(MAIN), test, "left")
        here = F.coalesce(F.col(f"{MAIN}.__here"), F.lit(False))
        hits = [here & F.coalesce(all_of(_bound_test(link, sub, main, i) for link in rest), F.lit(False)) for i, rest in group]
        out = joined.select(*[col(c, SUB) for c in out.columns], *[hit.alias(_hit(i)) for hit, (i, _) in zip(hits, group)])
    return out


def link_terms(sub, main, on, tree, sub_names=(), main_names=()) -> list:
    """Top-level conjuncts of ON text and condition tree."""
    names = {**{n: MAIN for n in main_names}, **{n: SUB for n in sub_names}}
    both = Node("AND", (on_text(on, sub.schema, main.schema, names), link_tree(tree, sub.schema, main.schema)))
    return list(_flat(both))


def _flat(term):
    if isinstance(term, Node) and (term.op == "AND" or len(term.items) == 1):
        for item in term.items:
            yield from _flat(item)
    else:
        yield term


def _is_equality(term) -> bool:
    return isinstance(term, Link) and term.op == "="


def _some_row(main: DataFrame) -> DataFrame:
    """At most one row: whether main has any."""
    return main.select(F.lit(True).alias("__some")).limit(1)


def _links(term) -> list[Link]:
    if isinstance(term, Node):
        return [link for item in term.items for link in _links(item)]
    return [term] if isinstance(term, Link) else []


def _semi(sub: DataFrame, main: DataFrame, terms: Sequence) -> DataFrame:
    """Semi join with equality keys, or with text whose keys Spark finds itself."""
    own = [t.test for t in terms if isinstance(t, Own)]
    sub = sub.alias(SUB).where(all_of(own)) if own else sub
    if any(isinstance(t, Text) for t in terms):
        needed = main
    else:
        needed = main.select(*[col(n) for n in unique(link.main_field for t in terms for link in _links(t))])
    linked = [t for t in terms if not isinstance(t, Own)]
    keys, rest = [t for t in linked if _is_equality(t)], [t for t in linked if not _is_equality(t)]
    if len(rest) == 1 and isinstance(rest[0], Link) and rest[0].op in _BOUND:
        return _semi_bounded(sub, main, keys, rest[0])
    if len(rest) == len(linked) - len(keys) == 2 and (steps := _steps(sub, main, keys, rest)):
        return _semi_steps(sub, main, keys, *steps)
    if not any(isinstance(t, Text) for t in rest):
        needed = needed.distinct()
    test = all_of(term_column(t, sub.schema, main.schema) for t in linked)
    return sub.alias(SUB).join(needed.alias(MAIN), test, "left_semi")


# Some main value stands in the relation to x exactly when one of these bounds does.
_BOUND = {">": ("min",), ">=": ("min",), "<": ("max",), "<=": ("max",), "!=": ("min", "max")}


def _bounds(link: Link, main: DataFrame, branch: int = 0) -> list[Column]:
    value = col(link.main_field)
    return [getattr(F, side)(value).alias(f"__{side}{branch}") for side in _BOUND[link.op]]


def _bound_test(link: Link, sub: DataFrame, main: DataFrame, branch: int = 0) -> Column:
    s_type, m_type = V.field_type(sub.schema, link.field), V.field_type(main.schema, link.main_field)
    return any_of(
        link_test(col(link.field, SUB), s_type, link.op, F.col(f"{MAIN}.__{side}{branch}"), m_type)
        for side in _BOUND[link.op]
    )


def _comparable(link: Link, sub: DataFrame, main: DataFrame) -> bool:
    """Minimum and maximum decide only when both sides are ordered the same way."""
    return V.kind(V.field_type(sub.schema, link.field)) == V.kind(V.field_type(main.schema, link.main_field))


def _semi_bounded(sub: DataFrame, main: DataFrame, keys: Sequence[Link], link: Link) -> DataFrame:
    test = [term_column(k, sub.schema, main.schema) for k in keys]
    if not _comparable(link, sub, main):
        needed = main.select(*[col(n) for n in unique(k.main_field for k in [*keys, link])]).distinct()
        test.append(link.column(sub.schema, main.schema))
    else:
        needed = main.groupBy(*[col(n) for n in unique(k.main_field for k in keys)]).agg(*_bounds(link, main))
        test.append(_bound_test(link, sub, main))
    return sub.alias(SUB).join(needed.alias(MAIN), all_of(test), "left_semi")


def _steps(sub: DataFrame, main: DataFrame, keys: Sequence[Link], rest: Sequence) -> tuple[Link, Link] | None:
    """The two comparisons, one that lies on an axis first; None if there are others."""
    if not all(isinstance(k, Link) and k.op in ORDERING and _comparable(k, sub, main) for k in rest) or not all(_comparable(k, sub, main) for k in keys):
        return None
    on = [k for k in rest if all(on_axis(F.lit(None), V.field_type(d.schema, f)) is not None for d, f in ((sub, k.field), (main, k.main_field)))]
    return (on[0], next(k for k in rest if k is not on[0])) if on else None


def _semi_steps(sub: DataFrame, main: DataFrame, keys: Sequence[Link], first: Link, second: Link) -> DataFrame:
    best = best_bounds(main, sub, [(k.field, k.main_field) for k in keys], *[(k.field, k.op, k.main_field) for k in (first, second)])
    test = [col(k.field, SUB) == F.col(f"{MAIN}.k{i}") for i, k in enumerate(keys)]
    s_type, m_type = V.field_type(sub.schema, second.field), V.field_type(main.schema, second.main_field)
    test += [col(first.field, SUB) == F.col(f"{MAIN}.x"), link_test(col(second.field, SUB), s_type, second.op, F.col(f"{MAIN}.best"), m_type)]
    return sub.alias(SUB).join(best.alias(MAIN), all_of(test), "left_semi")


def _branches(terms: Sequence) -> list[tuple[list[Column], list[Link]]]:
    """The condition as an OR of conjunctions: EXISTS of an OR is the OR of the EXISTS."""

    def expand(term) -> list[list]:
        if not isinstance(term, Node):
            return [[term]]
        choices = [expand(i) for i in term.items]
        if term.op == "OR":
            return [branch for options in choices for branch in options]
        return [list(itertools.chain(*pick)) for pick in itertools.product(*choices)]

    branches = expand(Node("AND", tuple(terms)))
    return [([t.test for t in b if isinstance(t, Own)], [t for t in b if isinstance(t, Link)]) for b in branches]


def _keep(sub: DataFrame, main: DataFrame, links: Sequence[Link]) -> DataFrame:
    """Rows of ``sub`` for which some main row satisfies all links."""
    if not links:
        return sub.join(F.broadcast(_some_row(main)), F.lit(True), "left_semi")
    if any(_is_equality(t) for t in links):
        return _semi(sub, main, links)
    if len(links) == 1:
        link = links[0]
        if link.op in _BOUND and _comparable(link, sub, main):
            bounds = main.agg(*_bounds(link, main))  # one row
            return sub.alias(SUB).join(F.broadcast(bounds.alias(MAIN)), _bound_test(link, sub, main), "left_semi")
        if link.op in (*TEXT_LINKS, "not_contains"):
            return _semi_text(sub, main, link)
    if len(links) == 2 and (steps := _steps(sub, main, (), links)):
        return _semi_steps(sub, main, (), *steps)
    fields, mains = unique(k.field for k in links), unique(k.main_field for k in links)
    needed = main.select(*[col(n) for n in mains]).distinct()
    test = all_of(k.column(sub.schema, main.schema) for k in links)
    if fits_broadcast(needed):
        return sub.alias(SUB).join(F.broadcast(needed.alias(MAIN)), test, "left_semi")
    values = sub.select(*[col(f) for f in fields]).where(filled(sub.schema, fields)).distinct()
    pairs = values.alias(SUB).join(needed.alias(MAIN), test, "inner")
    found = pairs.select(*[col(f, SUB) for f in fields]).distinct()
    return sub.alias(SUB).join(found.alias("f"), all_of(col(f, SUB) == col(f, "f") for f in fields), "left_semi")


def _semi_text(sub: DataFrame, main: DataFrame, link: Link) -> DataFrame:
    cell = V.text_column(sub.schema, link.field)
    values = sub.select(cell.alias("value")).where(F.col("value").isNotNull()).distinct()
    needles = main.select(V.text_column(main.schema, link.main_field).alias("needle"))
    found = lacking(values, needles) if link.op == "not_contains" else text_matches(values, needles, link.op)
    own = V.text_column(sub.schema, link.field, SUB)
    return sub.alias(SUB).join(found.alias("f"), own == F.col("f.value"), "left_semi")
