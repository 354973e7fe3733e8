"""Projection, distinct, order, limit and pages. Nulls sort last in both directions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.names import col, known_fields

Sort = str | tuple[str, bool] | Mapping[str, Any]


def sort_columns(sorts: Sequence[Sort]) -> list[tuple[str, bool]]:
    """(field, ascending) pairs; the first mention of a field wins."""
    out: dict[str, bool] = {}
    for s in sorts:
        if isinstance(s, str):
            name, asc = s, True
        elif isinstance(s, Mapping):
            name, asc = s.get("field"), s.get("ascending") is not False
        else:
            name, asc = s
        if name:
            out.setdefault(name, asc)
    return list(out.items())


def ordering(sorts: Sequence[tuple[str, bool]]) -> list[Column]:
    return [col(n).asc_nulls_last() if asc else col(n).desc_nulls_last() for n, asc in sorts]


def view(
    df: DataFrame,
    fields: Sequence[str | Mapping[str, Any]] = (),
    sorts: Sequence[Sort] = (),
    limit: int | None = None,
    on_missing: str = "error",
) -> DataFrame:
    """Select fields, de-duplicate, sort, cut. If any field is marked distinct, only the marked
    fields remain. Sorting by a field outside the selection is ignored. Sort and limit together
    plan as one top-k."""
    named = [(f, False) if isinstance(f, str) else (f.get("field"), bool(f.get("distinct"))) for f in fields]
    marked = [n for n, distinct in named if n and distinct]
    chosen = known_fields(df, marked or [n for n, _ in named], on_missing, "view")
    if chosen:
        df = df.select(*[col(c) for c in chosen])
        if marked:
            df = df.distinct()
    order = [(n, asc) for n, asc in sort_columns(sorts) if n in df.columns]
    if order:
        df = df.orderBy(*ordering(order))
    if isinstance(limit, int) and not isinstance(limit, bool) and limit >= 0:
        df = df.limit(limit)
    return df


def sort(df: DataFrame, field: str | None, ascending: bool | None = True, on_missing: str = "error") -> DataFrame:
    """Order by one field."""
    if not field or not known_fields(df, [field], on_missing, "sort"):
        return df
    return df.orderBy(*ordering([(field, ascending is not False)]))


def distinct_values(df: DataFrame, field: str, distinct: bool = True) -> DataFrame:
    """One column of a table, de-duplicated by default: what ``save`` captures."""
    out = df.select(col(field))
    return out.distinct() if distinct else out


def page(
    df: DataFrame, number: int, size: int, order_by: Sequence[Sort], total: str | None = None
) -> DataFrame:
    """Rows of page ``number`` (from 1). ``order_by`` must end in a unique key, or pages may overlap.
    ``total`` names a column for the row count of the whole result, which is counted on its own."""
    if number < 1 or size < 0:
        raise ValueError("pages count from 1 and sizes are not negative")
    order = sort_columns(order_by)
    known_fields(df, [n for n, _ in order], "error", "page")
    rows = df.orderBy(*ordering(order)).offset((number - 1) * size).limit(size)
    if total is None:
        return rows
    return rows.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(total))))  # one row


def preview(df: DataFrame, rows: int = 50) -> DataFrame:
    """The first rows of a table, in no particular order."""
    return df.limit(rows)
