"""Joins of two tables: equi, multi-key, theta, cross; suffixes, shared keys, null-safe keys."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import values as V
from tributary.functions.expressions import Bindings
from tributary.functions.links import FLIPPED, conjuncts, plain_comparisons, requalify
from tributary.functions.names import col, unique
from tributary.functions.predicates import ORDERING, all_of
from tributary.functions.sizing import estimated_bytes, fits_broadcast, known_large
from tributary.operators import band, skew

# Join words and Spark's names for them.
JOIN_TYPES = {"left": "left", "right": "right", "inner": "inner", "full": "full", "cross": "cross"}
Comparison = tuple[str, str, str]
LEFT, RIGHT = "t1", "t2"


def join(
    left: DataFrame,
    right: DataFrame,
    on: str | Column | Sequence[str | tuple] | None = None,
    how: str | None = "left",
    suffix: str = "_joined",
    null_safe: bool = False,
    variables: Mapping[str, Any] | None = None,
    left_names: Sequence[str] = (),
    right_names: Sequence[str] = (),
    spread: bool | None = None,
    product: bool = False,
) -> DataFrame:
    """Join two tables.

    ``on`` is ON text (``orders.cid = customers.id AND ...``, table prefixes optional), a list of
    names, ``(left, right)`` or ``(left, op, right)`` tuples, or a Column over the aliases ``t1`` and
    ``t2``. Nothing, or ``1=1``, means a cross join. A key of the same name on both sides comes out
    once; any other name on both sides keeps its left column and gets ``suffix`` on the right.
    ``null_safe`` lets null keys match each other. ``left_names`` / ``right_names`` are the table
    names and aliases that may prefix columns in the text. ``spread`` says whether an outer join
    guards against hot keys on the side it pads (see ``skew``): by default when that side is too
    large to broadcast. ``False`` saves a count of that side's keys when they are known to be unique.
    Text that is more than comparisons is cut at its ANDs: comparisons between the tables count like any, the rest must
    hold besides. Without an equality, a column that the other side's columns bound is cut into cells, and rows meet in the cells they
    share (see ``band``). A join without that compares every pair of rows, so a side that can be held by every executor must be
    within the broadcast bound, or ``product`` must say that the work is wanted.
    """
    how = JOIN_TYPES.get((how or "left").lower(), "left")
    names = {LEFT: LEFT, RIGHT: RIGHT, **{n: LEFT for n in left_names}, **{n: RIGHT for n in right_names}}
    if how == "cross" or on is None or (isinstance(on, (str, list, tuple)) and _is_always(on)):
        _check_product(left, right, how, product)
        joined = left.alias(LEFT).crossJoin(right.alias(RIGHT)) if how in ("cross", "inner") else left.alias(
            LEFT
        ).join(right.alias(RIGHT), F.lit(True), how)
        return joined.select(*_output(left, right, [], how, suffix))

    terms, free = _terms(on, left, right, names)
    keys = [(a, b) for a, op, b in terms if op == "="]
    shared = [a for a, b in keys if a == b]
    wide, rest = left, None
    if free is not None:
        bindings = Bindings(variables)
        rest = F.expr(bindings.bind(free)) if isinstance(free, str) else free
        wide = bindings.attach(left)
    if not keys and not isinstance(on, Column):
        found = band.find_band(left.schema, right.schema, terms, how != "right") if not _tiny(left, right) else None
        if not (found and found.lows and found.highs):  # bounded at one end only, a row meets a good part of all
            _check_product(left, right, how, product)
        if found:
            return _banded(left, wide, right, terms, rest, found, how, suffix)

    plain = len(keys) == len(terms) and not any(_needs_cast(left, right, k) for k in keys)
    padded = {"left": [right], "right": [left], "full": [left, right]}.get(how, [])
    guard = keys and padded and (spread if spread is not None else not all(map(fits_broadcast, padded)))
    if guard and (not plain or rest is not None):
        return _in_parts(left, wide, right, terms, rest, shared, how, suffix, null_safe)
    if rest is not None:
        joined = wide.alias(LEFT).join(right.alias(RIGHT), _all(left, right, terms, rest, null_safe), how)
        return joined.select(*_output(left, right, shared, how, suffix))
    if guard and how == "left":
        joined = skew.left_outer(left, right, keys, null_safe)
    elif guard and how == "right":
        # The mirror image; only the aliases differ.
        mirrored = skew.left_outer(right, left, [(b, a) for a, b in keys], null_safe)
        return mirrored.select(*_output(left, right, shared, how, suffix, sides=(RIGHT, LEFT)))
    elif guard:
        return _full(left, right, keys, shared, suffix, null_safe)
    else:
        test = all_of(_test(left, right, t, null_safe) for t in terms)
        joined = left.alias(LEFT).join(right.alias(RIGHT), test, how)
    return joined.select(*_output(left, right, shared, how, suffix))


def _is_always(on) -> bool:
    return on.replace(" ", "") in ("", "1=1") if isinstance(on, str) else len(on) == 0


def _check_product(left: DataFrame, right: DataFrame, how: str, allowed: bool) -> None:
    """Every pair of rows is compared; one side at least must be small, the padded one if rows are padded."""
    if allowed:
        return
    small = {"left": [right], "right": [left], "full": [left, right]}.get(how)
    large = any(map(known_large, small)) if small else known_large(left) and known_large(right)
    if large:
        raise ValueError(f"{how} join without an equality between sides that are too large to broadcast: give an equality, or product=True")


def _terms(on, left: DataFrame, right: DataFrame, names: Mapping[str, str]):
    """Comparisons left-op-right, and what else must hold: a condition only Spark can read, or None."""
    if isinstance(on, Column):
        return [], on
    if not isinstance(on, str):
        terms = [(t, "=", t) if isinstance(t, str) else ((t[0], "=", t[1]) if len(t) == 2 else tuple(t)) for t in on]
        return [_checked(t, left, right) for t in terms], None
    text = on.strip()
    if not any(c in text for c in "=<>") and " " not in text:
        key = text.rsplit(".", 1)[-1].strip('`"')
        return [_checked((key, "=", key), left, right)], None
    plain = plain_comparisons(text)
    if plain is None:
        return _split(text, left, right, names)
    terms = []
    for lp, lc, op, rp, rc in plain:
        ls, rs = names.get(lp), names.get(rp)
        if ls and ls == rs:
            return ([], requalify(text, names)) if len(plain) == 1 else _split(text, left, right, names)
        swap = ls == RIGHT or rs == LEFT
        if not (lp or rp) or (ls is None and rs is None) or ls == rs:
            swap = lc not in left.columns and lc in right.columns and rc in left.columns
        terms.append(_checked((rc, FLIPPED[op], lc) if swap else (lc, op, rc), left, right))
    return terms, None


BETWEEN = re.compile(r"(\S+)\s+BETWEEN\s+(\S+)\s+AND\s+(\S+)", re.I)


def _split(text: str, left: DataFrame, right: DataFrame, names: Mapping[str, str]):
    """Comparisons between the tables as terms, the other conjuncts as text."""
    terms, rest = [], []
    for part in conjuncts(text) or [text]:
        within = BETWEEN.fullmatch(part)
        both = f"{within[1]} >= {within[2]} AND {within[1]} <= {within[3]}" if within else part
        found, free = _terms(both, left, right, names) if _between_tables(both, left, right, names) else ([], part)
        if free is None:
            terms += found
        else:
            rest.append(part)
    return terms, requalify(" AND ".join(f"({p})" for p in rest), names) if rest else None


def _between_tables(text: str, left: DataFrame, right: DataFrame, names: Mapping[str, str]) -> bool:
    """Whether a text is equalities, or comparisons of a column of one table with one of the other."""
    plain = plain_comparisons(text)
    if plain and all(op == "=" for _, _, op, _, _ in plain):
        return True

    def side(prefix: str | None, column: str) -> str | None:
        if prefix:
            return names.get(prefix)
        there = (column in left.columns, column in right.columns)
        return {(True, False): LEFT, (False, True): RIGHT}.get(there)

    return bool(plain) and all({side(lp, lc), side(rp, rc)} == {LEFT, RIGHT} for lp, lc, _, rp, rc in plain)


def _checked(term: tuple, left: DataFrame, right: DataFrame) -> Comparison:
    a, op, b = term
    if a not in left.columns:
        raise ValueError(f"left table has no column '{a}'; columns are {left.columns}")
    if b not in right.columns:
        raise ValueError(f"right table has no column '{b}'; columns are {right.columns}")
    if op not in FLIPPED:
        raise ValueError(f"unknown join operator '{op}'")
    return a, op, b


def _needs_cast(left: DataFrame, right: DataFrame, key: tuple[str, str]) -> bool:
    return V.kind(V.field_type(left.schema, key[0])) != V.kind(V.field_type(right.schema, key[1]))


def _test(left: DataFrame, right: DataFrame, term: Comparison, null_safe: bool) -> Column:
    a, op, b = term
    x, y = V.aligned(
        col(a, LEFT), V.field_type(left.schema, a), col(b, RIGHT), V.field_type(right.schema, b)
    )
    if op == "=":
        return x.eqNullSafe(y) if null_safe else x == y
    return x != y if op == "!=" else ORDERING[op](x, y)


def _output(
    left: DataFrame, right: DataFrame, shared: Sequence[str], how: str, suffix: str, sides=(LEFT, RIGHT)
) -> list[Column]:
    lside, rside = sides
    out = {}
    taken = _folded(left.columns)
    for c in left.columns:
        both = c in shared and how in ("right", "full")
        out[c] = F.coalesce(col(c, lside), col(c, rside)) if both else col(c, lside)
    for c in right.columns:
        if c in shared:
            continue
        name = c + suffix if c.casefold() in taken else c
        if name.casefold() in _folded(out):
            raise ValueError(f"two columns would be named '{name}'; choose another suffix")
        out[name] = col(c, rside)
    return [c.alias(n) for n, c in out.items()]


def _folded(names) -> set[str]:
    """Names as Spark compares them."""
    return {n.casefold() for n in names}


def _full(
    left: DataFrame, right: DataFrame, keys: skew.Keys, shared: Sequence[str], suffix: str, null_safe: bool
) -> DataFrame:
    """A full join is the left join plus the right rows whose key the left never has. Spark can
    split a hot key in both halves, but not in its own full join."""
    half = skew.left_outer(left, right, keys, null_safe).select(*_output(left, right, shared, "full", suffix))
    terms = [(a, "=", b) for a, b in keys]
    return half.unionByName(_right_only(left, right, terms, shared, suffix, null_safe))


def _all(left: DataFrame, right: DataFrame, terms, rest: Column | None, null_safe: bool) -> Column:
    tests = [_test(left, right, t, null_safe) for t in terms]
    return all_of(tests if rest is None else [*tests, rest])


def _in_parts(
    left: DataFrame, wide: DataFrame, right: DataFrame, terms, rest: Column | None, shared: Sequence[str], how: str, suffix: str, null_safe: bool
) -> DataFrame:
    """An outer join on more than equal keys as its inner join plus the rows without a partner.
    Adaptive execution can split a hot key in each part. ``wide`` is ``left`` with what ``rest`` needs besides."""
    test = _all(left, right, terms, rest, null_safe)
    inner = wide.alias(LEFT).join(right.alias(RIGHT), test, "inner")
    out = inner.select(*_output(left, right, shared, how, suffix))
    if how in ("left", "full"):
        others = right if rest is not None else right.select(*[col(n) for n in unique(b for _, _, b in terms)]).distinct()
        alone = wide.alias(LEFT).join(others.alias(RIGHT), test, "left_anti")
        out = out.unionByName(_padded_left(alone, left, right, shared, suffix))
    if how in ("right", "full"):
        others = wide if rest is not None else left.select(*[col(n) for n in unique(a for a, _, _ in terms)]).distinct()
        alone = right.alias(RIGHT).join(others.alias(LEFT), test, "left_anti")
        out = out.unionByName(_padded_right(alone, left, right, shared, suffix))
    return out


def _padded_left(alone: DataFrame, left: DataFrame, right: DataFrame, shared: Sequence[str], suffix: str) -> DataFrame:
    """Left rows without a partner."""
    taken = _folded(left.columns)
    pads = [
        F.lit(None).cast(f.dataType).alias(f.name + suffix if f.name.casefold() in taken else f.name)
        for f in right.schema
        if f.name not in shared
    ]
    return alone.select(*[col(c) for c in left.columns], *pads)


def _padded_right(alone: DataFrame, left: DataFrame, right: DataFrame, shared: Sequence[str], suffix: str) -> DataFrame:
    """Right rows without a partner."""
    pads = [
        col(f.name).alias(f.name) if f.name in shared else F.lit(None).cast(f.dataType).alias(f.name)
        for f in left.schema
    ]
    taken = _folded(left.columns)
    kept = [col(c).alias(c + suffix if c.casefold() in taken else c) for c in right.columns if c not in shared]
    return alone.select(*pads, *kept)


def _right_only(left: DataFrame, right: DataFrame, terms, shared: Sequence[str], suffix: str, null_safe: bool):
    others = left.select(*[col(n) for n in unique(a for a, _, _ in terms)]).distinct()
    alone = right.alias(RIGHT).join(others.alias(LEFT), _all(left, right, terms, None, null_safe), "left_anti")
    return _padded_right(alone, left, right, shared, suffix)


#: A side of so many bytes is compared with every row of the other sooner than an axis is made.
TINY = 32 << 10
#: A side of so many bytes for each core is read by many tasks, whatever else is done to it.
SPREAD_BYTES = 64 << 20


def _tiny(left: DataFrame, right: DataFrame) -> bool:
    sizes = [estimated_bytes(x) for x in (left, right)]
    return any(x is not None and x <= TINY for x in sizes)


def _banded(
    left: DataFrame, wide: DataFrame, right: DataFrame, terms, rest: Column | None, found: band.Band, how: str, suffix: str
) -> DataFrame:
    """A join by ranges. The side that stands in one cell may be padded by the join itself; of the other, the rows without a partner are added.

    Spark's estimate for the copied side knows nothing of its copies, nor of the pairs they lead to. So that side is never broadcast, and the other only beside
    one that is read by many tasks; else both are merged by cells, where a cell's points are compared in a row.
    """
    points, of_points = (LEFT, "left") if found.of_left else (RIGHT, "right")
    cells = F.col(f"{LEFT}.{band.CELL}") == F.col(f"{RIGHT}.{band.CELL}")
    test = cells & _all(left, right, terms, rest, False)
    lcells, rcells = band.in_cells(wide, right, found)
    own, copied = (left, right) if found.of_left else (right, left)
    aside = fits_broadcast(own) and known_large(copied, SPREAD_BYTES * left.sparkSession.sparkContext.defaultParallelism)
    hint = "broadcast" if aside else "merge"
    lcells, rcells = (lcells.hint(hint), rcells) if found.of_left else (lcells, rcells.hint(hint))
    if how in (of_points, "full"):
        out = lcells.alias(LEFT).join(rcells.alias(RIGHT), test, of_points)
    elif found.of_left:
        out = rcells.alias(RIGHT).join(lcells.alias(LEFT), test)  # a merge holds a cell's rows of the second side
    else:
        out = lcells.alias(LEFT).join(rcells.alias(RIGHT), test)
    out = out.select(*_output(left, right, [], how, suffix))
    if how not in ("inner", of_points):
        # A row of the other side may stand in several cells: it is alone if none of its values has a partner in any.
        side, data, cut, others = (RIGHT, right, rcells, lcells) if found.of_left else (LEFT, wide, lcells, rcells)
        names = data.columns if rest is not None else unique(b if found.of_left else a for a, _, b in terms)
        values = cut.select(*[col(n) for n in names], band.CELL).distinct()
        met = values.alias(side).join(others.alias(points), test, "left_semi").select(*[col(n) for n in names]).distinct()
        alone = data.alias("a").join(met.alias("b"), all_of(col(n, "a").eqNullSafe(col(n, "b")) for n in names), "left_anti")
        pad = _padded_right if found.of_left else _padded_left
        out = out.unionByName(pad(alone, left, right, [], suffix))
    return out
