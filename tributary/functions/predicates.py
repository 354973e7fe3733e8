"""Filter conditions as Spark columns.

A condition is a record ``{field, operator, value, valueType?, dataType?}``; a group is
``{logicalOperator, conditions: [...]}``. Null rules, the same for every operator: a positive
test is never true for null, a negated test (``!=``, ``not_contains``, ``not_in_list`` ...) keeps
null. Negations are written ``c IS NULL OR c <> v`` because that form is pushed into Parquet scans.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator as op_
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import values as V
from tributary.functions.names import col

ORDERING = {">": op_.gt, ">=": op_.ge, "<": op_.lt, "<=": op_.le}
NEGATED = {
    "!=": "=",
    "not_contains": "contains",
    "not_in_list": "in_list",
    "not_in_variable": "in_variable",
}

# A captured column used as a value: (operator, field, one-column DataFrame) -> Column.
Captured = Callable[[str, str, DataFrame], Column]


def resolve(value: Any, value_type: str | None, variables: Mapping[str, Any], on_missing: str = "error") -> Any:
    """Replace ``{name}`` (or any name when ``value_type`` is 'variable') by the variable's value."""
    if isinstance(value, str):
        braced = len(value) > 2 and value[0] == "{" and value[-1] == "}"
        name = value[1:-1] if braced else value
        if name in variables and (braced or value_type == "variable"):
            return variables[name]
        if value_type == "variable" and on_missing == "error":
            raise ValueError(f"unknown variable '{name}'")
    return value


def condition(
    schema: T.StructType,
    cond: Mapping[str, Any],
    variables: Mapping[str, Any] | None = None,
    on_missing: str = "error",
    regex: bool = False,
    captured: Captured | None = None,
) -> Column:
    """One leaf condition. ``on_missing='pass'`` makes a condition true when it names an absent
    column or an unknown operator, or has a value that does not fit; an unknown variable is an
    empty list then."""
    variables = variables or {}
    name, op = cond.get("field"), cond.get("operator")
    if op in ("always_true", "always_false"):
        return F.lit(op == "always_true")
    if name not in schema.fieldNames():
        if on_missing == "error":
            raise ValueError(f"condition on unknown column '{name}'; columns are {schema.fieldNames()}")
        return F.lit(True)

    c, dtype = col(name), V.field_type(schema, name)
    k, text = V.kind(dtype), V.text_of(col(name), dtype)
    missing = c.isNull() | F.isnan(c) if V.is_floating(dtype) else c.isNull()  # NaN is no value
    match op:
        case "is_null":
            return missing
        case "is_not_null":
            return ~missing if V.is_floating(dtype) else c.isNotNull()
        case "is_empty":
            return missing | (text == "")
        case "is_not_empty":
            return ~missing & (text != "") if V.is_floating(dtype) else c.isNotNull() & (text != "")
        case "is_true" | "is_false":
            flag = c if k == "boolean" else text.try_cast("boolean")
            return flag.eqNullSafe(op == "is_true")

    value = resolve(cond.get("value"), cond.get("valueType"), variables, on_missing)
    if op in ("in_variable", "not_in_variable") and isinstance(value, str):
        if value in variables:
            value = variables[value]
        elif value is cond.get("value") or value == cond.get("value"):
            if on_missing == "error":
                raise ValueError(f"unknown variable '{value}'")
            value = []
    if isinstance(value, DataFrame):
        if captured is None:
            raise ValueError(f"'{op}' on '{name}': a captured column needs a join; use operators.where")
        return captured(op, name, value)

    try:
        test = _positive(c, text, dtype, k, NEGATED.get(op, op), value, cond.get("dataType"), regex)
    except ValueError:
        if on_missing == "error":
            raise
        return F.lit(True)
    if test is None:
        if on_missing == "error":
            raise ValueError(f"unknown operator '{op}' on column '{name}'")
        return F.lit(True)
    if op in NEGATED:
        if op == "not_in_variable" and _has_null(value):
            return c.isNotNull() & ~test
        if _reads_as_other_kind(k, value, cond.get("dataType")):
            return ~F.coalesce(test, F.lit(False))
        return c.isNull() | ~test
    if op == "in_variable" and _has_null(value):
        return c.isNull() | test
    return test


def _has_null(value: Any) -> bool:
    return isinstance(value, (list, tuple)) and any(v is None for v in value)


def _positive(
    c: Column, text: Column, dtype: T.DataType, k: str, op: str | None, value: Any, data_type: str | None, regex: bool
) -> Column | None:
    if op in ("contains", "starts_with", "ends_with"):
        if op == "contains":
            return contains_any(text, V.parts(value), regex)
        return text.startswith(str(value)) if op == "starts_with" else text.endswith(str(value))
    if op == "has_key":
        return _has_key(c, dtype, str(value))
    if op in ("in_list", "in_variable"):
        return _member(c, text, dtype, k, value, data_type)
    if op in ("before", "after"):
        moment, _ = V.as_moment(value)
        cell, cell_type = _moments(c, dtype, k)
        limit = V.moment_literal(moment, cell_type)
        return cell < limit if op == "before" else cell > limit
    if op == "=":
        return _equals(c, text, dtype, k, value, data_type)
    if op in ORDERING:
        return _ordered(c, dtype, k, ORDERING[op], value, data_type)
    return None


def contains(text: Column, part: str, regex: bool = False) -> Column:
    """Case-insensitive containment; the part is literal text unless ``regex``."""
    if regex:
        return F.rlike(text, F.lit(f"(?i){part}"))
    return F.contains(F.lower(text), F.lower(F.lit(part)))


def contains_any(text: Column, many: Sequence[str], regex: bool = False) -> Column:
    """Some part is contained. From four parts on the text is lowered once instead of per part."""
    if regex or len(many) < 4:
        return any_of(contains(text, p, regex) for p in many)
    needles = F.array(*[F.lower(F.lit(p)) for p in many])
    return F.exists(F.array(F.lower(text)), lambda t: F.exists(needles, lambda p: F.contains(t, p)))


def _is_numeric(k: str, value: Any, data_type: str | None) -> bool:
    return data_type == "number" or (isinstance(value, (int, float)) and not isinstance(value, bool))


def _reads_as_other_kind(k: str, value: Any, data_type: str | None) -> bool:
    """Whether cells are cast for the test, so that one that has a value may still give null."""
    if data_type in ("date", "timestamp"):
        return k not in ("date", "timestamp")
    return (isinstance(value, bool) or _is_numeric(k, value, data_type)) and k not in ("number", "boolean")


def _number(value: Any) -> int | float:
    number = V.as_number(value)
    if number is None:
        raise ValueError(f"'{value}' is not a number")
    return number


def _numbers(c: Column, k: str) -> Column:
    if k == "number":
        return c
    return c.cast("int") if k == "boolean" else c.cast("string").try_cast("double")


def _moments(c: Column, dtype: T.DataType, k: str) -> tuple[Column, T.DataType]:
    if k in ("date", "timestamp"):
        return c, dtype
    return c.cast("string").try_cast("timestamp"), T.TimestampType()


def on_day(cell: Column, cell_type: T.DataType, value: Any) -> Column:
    """Same calendar day; a value with a time of day means that very moment. Timestamps are
    compared as a half-open range, which prunes row groups, rather than through a cast."""
    moment, whole_day = V.as_moment(value)
    if not whole_day or V.kind(cell_type) == "date":
        if V.kind(cell_type) == "date" and isinstance(moment, dt.datetime):
            moment = moment.date()
        return cell == V.moment_literal(moment, cell_type)
    start = V.moment_literal(moment, cell_type)
    end = V.moment_literal(moment + dt.timedelta(days=1), cell_type)
    return (cell >= start) & (cell < end)


def _equals(c: Column, text: Column, dtype: T.DataType, k: str, value: Any, data_type: str | None) -> Column:
    if isinstance(value, bool) or k == "boolean":
        flag = V.as_bool(value)
        if k in ("boolean", "text") and flag is not None:
            return (c if k == "boolean" else text.try_cast("boolean")) == F.lit(flag)
        if k == "boolean":
            return F.lit(False)
    if k in ("date", "timestamp") or data_type in ("date", "timestamp"):
        return on_day(*_moments(c, dtype, k), value)
    if _is_numeric(k, value, data_type):
        return _numbers(c, k) == F.lit(_number(value))
    if k == "number":
        number = V.as_number(value)
        return F.lit(False) if number is None else c == F.lit(number)
    return text == F.lit(str(value))


def _ordered(
    c: Column, dtype: T.DataType, k: str, compare: Callable, value: Any, data_type: str | None
) -> Column:
    if k in ("date", "timestamp") or data_type in ("date", "timestamp"):
        cell, cell_type = _moments(c, dtype, k)
        return compare(cell, V.moment_literal(V.as_moment(value)[0], cell_type))
    if k == "number" or _is_numeric(k, value, data_type):
        cell = _numbers(c, k)
        test = compare(cell, F.lit(_number(value)))
        # Spark orders NaN above all numbers; the comparison itself still reaches the scan.
        above = compare in (op_.gt, op_.ge) and (V.is_floating(dtype) or k not in ("number", "boolean"))
        return test & ~F.isnan(cell) if above else test
    return compare(c, F.lit(str(value)).try_cast(dtype))


def _member(c: Column, text: Column, dtype: T.DataType, k: str, value: Any, data_type: str | None) -> Column:
    items = [v for v in value if v is not None] if isinstance(value, (list, tuple)) else V.parts(value)
    if k == "number" or data_type == "number":
        numbers = [n for n in map(V.as_number, items) if n is not None]
        return _numbers(c, k).isin(numbers) if numbers else F.lit(False)
    if k == "boolean":
        flags = [f for f in map(V.as_bool, items) if f is not None]
        return c.isin(flags) if flags else F.lit(False)
    if k in ("date", "timestamp"):
        return any_of(on_day(c, dtype, v) for v in items if str(v).strip())
    return text.isin([str(v) for v in items]) if items else F.lit(False)


def _has_key(c: Column, dtype: T.DataType, key: str) -> Column:
    if isinstance(dtype, T.StructType):
        return c.isNotNull() if key in dtype.fieldNames() else F.lit(False)
    if isinstance(dtype, T.MapType):
        return F.map_contains_key(c, key)
    return F.array_contains(F.json_object_keys(c), key)


def filled(schema: T.StructType, names: Iterable[str]) -> Column:
    """All named cells have a value; NaN counts as none. Written so that scans can use it."""

    def test(name: str) -> Column:
        c = col(name)
        return c.isNotNull() & ~F.isnan(c) if V.is_floating(V.field_type(schema, name)) else c.isNotNull()

    return all_of(test(n) for n in names)


def any_of(tests) -> Column:
    return functools.reduce(op_.or_, tests, F.lit(False))


def all_of(tests) -> Column:
    return functools.reduce(op_.and_, tests, F.lit(True))


def group(
    schema: T.StructType,
    tree: Mapping[str, Any],
    variables: Mapping[str, Any] | None = None,
    on_missing: str = "error",
    regex: bool = False,
    captured: Captured | None = None,
) -> Column:
    """Nested AND/OR group. An empty group is true; any operator word but AND means OR."""
    tests = [
        group(schema, item, variables, on_missing, regex, captured)
        if is_group(item)
        else condition(schema, item, variables, on_missing, regex, captured)
        for item in tree.get("conditions") or []
    ]
    if not tests:
        return F.lit(True)
    return functools.reduce(op_.and_ if tree.get("logicalOperator", "AND") == "AND" else op_.or_, tests)


def is_group(item: Mapping[str, Any]) -> bool:
    return item.get("type") == "group" or ("conditions" in item and "field" not in item)


def search(
    schema: T.StructType,
    text: str,
    column: str | None = None,
    mode: str = "contains",
    case_sensitive: bool = False,
) -> Column:
    """One text looked for in every column, or in one. Null never matches."""
    needle = text.strip()
    if not needle:
        return F.lit(True)

    def test(name: str) -> Column:
        cell, want = V.text_column(schema, name), F.lit(needle)
        if not case_sensitive:
            cell, want = F.lower(cell), F.lower(want)
        match mode:
            case "equals":
                return cell == want
            case "starts":
                return F.startswith(cell, want)
            case "ends":
                return F.endswith(cell, want)
            case "contains":
                return F.contains(cell, want)
        raise ValueError(f"unknown search mode '{mode}'")

    return any_of(F.coalesce(test(n), F.lit(False)) for n in ([column] if column else schema.fieldNames()))
