"""Filtering, including membership in a captured column.

Conditions on plain values become one Spark predicate. A captured column (a ``DataFrame`` variable)
is never brought to the driver: as a conjunct it is a semi or anti join, inside an OR it is a left
join to its distinct values whose hit marks the row.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import predicates as P
from tributary.functions import values as V
from tributary.functions.names import col
from tributary.operators.text_match import text_matches

MEMBER_OPS = ("in_variable", "in_list", "=")
TEXT_OPS = ("contains", "starts_with", "ends_with")


def where(
    df: DataFrame,
    tree: Mapping[str, Any] | None,
    variables: Mapping[str, Any] | None = None,
    on_missing: str = "error",
    regex: bool = False,
) -> DataFrame:
    """Rows satisfying a condition record or a nested AND/OR group."""
    if not tree:
        return df
    variables, schema, columns = variables or {}, df.schema, df.columns
    conjuncts = _conjuncts(tree)
    joins = [c for c in conjuncts if _is_membership(c, schema, variables, on_missing)]
    hits = _Hits(df)
    for cond in (c for c in conjuncts if c not in joins):
        build = P.group if P.is_group(cond) else P.condition
        hits.tests.append(build(schema, cond, variables, on_missing, regex, hits.captured))
    out = hits.apply()
    for cond in joins:
        values = P.resolve(cond.get("value"), cond.get("valueType") or "variable", variables, on_missing)
        how = "left_anti" if cond["operator"] in P.NEGATED else "left_semi"
        members = _members(values, V.field_type(schema, cond["field"]), keep_null="variable" in cond["operator"])
        matched = col(cond["field"], "t").eqNullSafe(F.col("m.value"))
        out = out.alias("t").join(members.alias("m"), matched, how)
    return out.select(*[col(c) for c in columns])


def _conjuncts(tree: Mapping[str, Any]) -> list[Mapping[str, Any]]:
    if not P.is_group(tree):
        return [tree]
    items = tree.get("conditions") or []
    if tree.get("logicalOperator", "AND") != "AND" and len(items) > 1:
        return [tree]
    return [leaf for item in items for leaf in _conjuncts(item)]


def _is_membership(cond: Mapping[str, Any], schema: T.StructType, variables: Mapping[str, Any], on_missing: str) -> bool:
    op = cond.get("operator")
    if P.is_group(cond) or P.NEGATED.get(op, op) not in ("in_variable", "in_list"):
        return False
    if cond.get("field") not in schema.fieldNames():
        return False
    by_name = cond.get("valueType") or ("variable" if "variable" in op else None)
    return isinstance(P.resolve(cond.get("value"), by_name, variables, "pass"), DataFrame)


def _members(values: DataFrame, data_type: T.DataType, keep_null: bool) -> DataFrame:
    """Distinct values of a captured column, read as the type of the field they are looked up by."""
    name = values.columns[0]
    source = V.field_type(values.schema, name)
    c = col(name)
    if V.kind(source) != V.kind(data_type):
        cast = V.text_of(c, source).try_cast(data_type)
        values, c = values.where(c.isNull() | cast.isNotNull()), cast
    out = values.select(c.alias("value"))
    return (out if keep_null else out.where(F.col("value").isNotNull())).distinct()


class _Hits:
    """Conditions of one filter, and the lookups some of them need."""

    def __init__(self, df: DataFrame):
        self.df, self.lookups, self.tests = df, [], []

    def captured(self, op: str, field: str, values: DataFrame) -> Column:
        positive, data_type = P.NEGATED.get(op, op), V.field_type(self.df.schema, field)
        if positive in MEMBER_OPS:
            members = _members(values, data_type, keep_null=positive == "in_variable")
            cell = col(field)
        elif positive in TEXT_OPS:
            cell = V.text_column(self.df.schema, field)
            needle = V.text_column(values.schema, values.columns[0])
            own = self.df.select(cell.alias("value")).where(F.col("value").isNotNull()).distinct()
            members = text_matches(own, values.select(needle.alias("needle")), positive, positive == "contains")
        else:
            raise ValueError(f"'{op}' cannot be used with a captured column")
        hit = f"__hit{len(self.lookups)}"
        self.lookups.append((hit, cell, members))
        return F.col(hit).isNull() if op in P.NEGATED else F.col(hit).isNotNull()

    def apply(self) -> DataFrame:
        out = self.df
        for hit, cell, members in self.lookups:
            found = members.select(F.col("value").alias(f"{hit}_value"), F.lit(True).alias(hit))
            out = out.join(found, cell.eqNullSafe(F.col(f"{hit}_value")), "left")
        return out.where(P.all_of(self.tests)) if self.tests else out
