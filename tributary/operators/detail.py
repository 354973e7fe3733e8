"""Master/detail output: for each main row its matching detail rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import values as V
from tributary.functions.links import MAIN, SUB, Link, term_column
from tributary.functions.names import col
from tributary.functions.predicates import all_of
from tributary.functions.sizing import fits_broadcast
from tributary.operators import skew
from tributary.operators.exists import link_terms


def _terms(main, sub, on, tree, sub_names, main_names) -> list:
    return link_terms(sub, main, on, tree, sub_names, main_names)


def match_counts(
    main: DataFrame,
    sub: DataFrame,
    on: str | None = None,
    tree: Mapping[str, Any] | None = None,
    sub_names: Sequence[str] = (),
    main_names: Sequence[str] = (),
) -> DataFrame:
    """``main.*`` plus ``match_count``. When all links are equalities, detail rows are counted per
    key before they meet the main table."""
    terms = _terms(main, sub, on, tree, sub_names, main_names)
    if not terms or not all(isinstance(t, Link) and t.op == "=" for t in terms):
        raise ValueError("match counts need equality links; use detail_rows for other links")
    keys = [f"__k{i}" for i in range(len(terms))]
    counts = sub.groupBy(*[col(t.field).alias(k) for t, k in zip(terms, keys)]).agg(F.count(F.lit(1)).alias("__n"))
    test = all_of(col(t.main_field, MAIN) == F.col(f"c.{k}") for t, k in zip(terms, keys))
    joined = main.alias(MAIN).join(counts.alias("c"), test, "left")
    return joined.select(*[col(c, MAIN) for c in main.columns], F.coalesce("c.__n", F.lit(0)).alias("match_count"))


def detail_rows(
    main: DataFrame,
    sub: DataFrame,
    on: str | None = None,
    tree: Mapping[str, Any] | None = None,
    sub_names: Sequence[str] = (),
    main_names: Sequence[str] = (),
) -> DataFrame:
    """One row per matching pair: ``main.*`` and the detail row as the struct ``detail``."""
    terms = _terms(main, sub, on, tree, sub_names, main_names)
    test = all_of(term_column(t, sub.schema, main.schema) for t in terms)
    pairs = main.alias(MAIN).join(sub.alias(SUB), test, "inner")
    row = F.struct(*[col(c, SUB).alias(c) for c in sub.columns])
    return pairs.select(*[col(c, MAIN) for c in main.columns], row.alias("detail"))


def nested_detail(
    main: DataFrame,
    sub: DataFrame,
    main_key: Sequence[str],
    on: str | None = None,
    tree: Mapping[str, Any] | None = None,
    sub_names: Sequence[str] = (),
    main_names: Sequence[str] = (),
    *,
    rows_per_part: int,
) -> DataFrame:
    """Main rows with their detail rows nested: ``main.*, match_count, part, details``.

    ``main_key`` identifies a main row. A main row has one output row, part 0, unless it has more
    than ``rows_per_part`` detail rows, which is the caller's to say; then those are dealt out by a hash over ``ceil(match_count / rows_per_part)``
    parts, so that no task builds an unbounded array. Equal detail rows are numbered and go to parts by turns. Every run deals the same.
    Main rows without detail have ``match_count`` 0 and an empty array. With links other than
    equalities the pairs are formed twice, once to count them.
    """
    terms = _terms(main, sub, on, tree, sub_names, main_names)
    equal = bool(terms) and all(isinstance(t, Link) and t.op == "=" for t in terms)
    if equal:
        counted = match_counts(main, sub, on, tree, sub_names, main_names)
    else:
        sizes = detail_rows(main, sub, on, tree, sub_names, main_names).groupBy(*[col(k) for k in main_key])
        sizes = sizes.agg(F.count(F.lit(1)).alias("match_count"))
        same = all_of(col(k, "a").eqNullSafe(col(k, "b")) for k in main_key)
        counted = main.alias("a").join(sizes.alias("b"), same, "left")
        counted = counted.select(*[col(c, "a") for c in main.columns], F.coalesce("match_count", F.lit(0)).alias("match_count"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("match_count") / rows_per_part)).alias("__parts")
    numbered = counted.select("*", parts)
    located = _numbered_copies(sub).withColumn("__match", F.lit(True))
    keys = [(t.main_field, t.field) for t in terms] if equal else []
    if equal and not fits_broadcast(sub) and _same_kinds(main, sub, keys):
        left, right, pairs = "t1", "t2", skew.left_outer(numbered, located, keys)
    else:
        test = all_of(term_column(t, sub.schema, main.schema) for t in terms)
        left, right, pairs = MAIN, SUB, numbered.alias(MAIN).join(located.alias(SUB), test, "left")
    detail = F.struct(*[col(c, right).alias(c) for c in sub.columns])
    dealt = pairs.select(
        *[col(c, left) for c in counted.columns],
        F.coalesce(F.pmod(F.pmod(F.xxhash64(detail), F.col("__parts")) + F.col("__at"), F.col("__parts")), F.lit(0)).alias("part"),
        F.when(F.col("__match"), detail).alias("__detail"),
    )
    others = [F.first(col(c)).alias(c) for c in counted.columns if c not in main_key]
    nested = dealt.groupBy(*[col(k) for k in main_key], "part").agg(
        *others, F.sort_array(F.collect_list("__detail")).alias("details")
    )
    return nested.select(*[col(c) for c in main.columns], "match_count", "part", "details")


def _numbered_copies(sub: DataFrame) -> DataFrame:
    """``sub`` with a number from 0 among rows that are equal, as ``__at``. Maps can't be compared: rows that hold one are all number 0."""
    if any(isinstance(f.dataType, T.MapType) for f in sub.schema):
        return sub.withColumn("__at", F.lit(0).cast("long"))
    counted = sub.groupBy(*[col(c) for c in sub.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    return counted.select(*[col(c) for c in sub.columns], F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)).alias("__at"))


def _same_kinds(main: DataFrame, sub: DataFrame, keys: skew.Keys) -> bool:
    return all(
        V.kind(V.field_type(main.schema, m)) == V.kind(V.field_type(sub.schema, s)) for m, s in keys
    )
