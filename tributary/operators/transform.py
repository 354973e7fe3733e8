"""Derived columns: expressions, Spark columns, row functions, batch functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.expressions import Bindings, NotPython, UnknownName, python_expression
from tributary.functions.names import col, known_fields
from tributary.functions.udfs import batch_function, row_function


@dataclass(frozen=True)
class UserFunction:
    """A Python function for a derived column. ``fields`` are the columns it reads (all when
    empty); ``batch`` functions take a pandas frame and return a Series."""

    fn: Callable
    return_type: str
    fields: Sequence[str] = ()
    batch: bool = False


def transform(
    df: DataFrame,
    mappings: Sequence[Mapping[str, Any]],
    variables: Mapping[str, Any] | None = None,
    functions: Mapping[str, UserFunction] | None = None,
    on_missing: str = "error",
) -> DataFrame:
    """Add columns ``{outputField, expression, mode}`` in one projection, so that each expression
    sees the input row and not its siblings. An output named like an input column replaces it.

    ``mode`` is ``simple`` (Python arithmetic, else SQL text), ``sql``, or ``python``: then the
    function registered in ``functions`` under the output field's or the expression's name runs.
    An expression may also be a Column or a UserFunction.
    """
    bindings = Bindings(variables)
    made: dict[str, Column] = {}
    for m in mappings:
        name, expression = m.get("outputField"), m.get("expression")
        if name and expression is not None and expression != "":
            made[name] = _column(df, name, expression, m.get("mode"), bindings, functions or {}, on_missing)
    if not made:
        return df
    kept = [made.pop(c).alias(c) if c in made else col(c) for c in df.columns]
    return bindings.attach(df).select(*kept, *[c.alias(n) for n, c in made.items()])


def _column(
    df: DataFrame,
    name: str,
    expression: Any,
    mode: str | None,
    bindings: Bindings,
    functions: Mapping[str, UserFunction],
    on_missing: str,
) -> Column:
    if isinstance(expression, Column):
        return expression
    if isinstance(expression, UserFunction) or mode == "python":
        user = expression if isinstance(expression, UserFunction) else functions.get(name) or functions.get(expression)
        if user is None:
            raise ValueError(f"column '{name}' needs a registered function; source text is not run")
        fields = known_fields(df, user.fields, "error", name) if user.fields else df.columns
        return (batch_function if user.batch else row_function)(user.fn, user.return_type, fields)
    if mode != "sql":
        try:
            return python_expression(expression, df.schema, bindings.variables)
        except NotPython:
            pass
        except UnknownName:
            if on_missing == "error":
                raise
            return F.lit(None).cast("string")
    return F.expr(bindings.bind(expression))
