"""Literals and column kinds: how a value typed by a user meets a typed column."""

from __future__ import annotations

import datetime as dt
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.names import col

WHOLE_TEXT = r"^\s*([+-]?\d+)(?:\.0*)?\s*$"
INT64 = (-(2**63), 2**63 - 1)


def kind(data_type: T.DataType) -> str:
    """number, text, boolean, date, timestamp, nested or other."""
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(data_type, (T.StructType, T.MapType, T.ArrayType)):
        return "nested"
    return "other"


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def text_of(column: Column, data_type: T.DataType) -> Column:
    """Text form of a cell; nested cells become JSON."""
    return F.to_json(column) if kind(data_type) == "nested" else column.cast("string")


def as_number(value: Any) -> int | float | None:
    """The number a value stands for, or None. Whole numbers stay whole so that an integer
    column is compared with an integer and the filter reaches the Parquet reader."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int):
        return value if INT64[0] <= value <= INT64[1] else float(value)
    try:
        number = float(str(value))
    except ValueError:
        return None
    if isinstance(value, str):
        try:
            exact = int(value)
            return exact if INT64[0] <= exact <= INT64[1] else number
        except ValueError:
            pass
    if math.isfinite(number) and number.is_integer() and abs(number) < 2**53:
        return int(number)
    return number


def as_bool(value: Any) -> bool | None:
    if isinstance(value, bool):
        return value
    return {"true": True, "false": False, "1": True, "0": False}.get(str(value).strip().lower())


def as_moment(value: Any) -> tuple[dt.date | dt.datetime, bool]:
    """(date or datetime, whether it names a whole day)."""
    if isinstance(value, dt.datetime):
        return value, False
    if isinstance(value, dt.date):
        return value, True
    text = str(value).strip()
    try:
        return dt.date.fromisoformat(text), True
    except ValueError:
        pass
    try:
        return dt.datetime.fromisoformat(text), False
    except ValueError:
        raise ValueError(f"'{value}' is not an ISO date or timestamp") from None


def moment_literal(value: dt.date | dt.datetime, data_type: T.DataType) -> Column:
    return F.lit(value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()).cast(data_type)


def parts(value: Any) -> list[str]:
    """A list as texts; a text cut at its commas, each part trimmed."""
    if isinstance(value, (list, tuple, set)):
        return [str(v) for v in value]
    return [p.strip() for p in str(value).split(",")]


def aligned(left: Column, left_type: T.DataType, right: Column, right_type: T.DataType) -> tuple[Column, Column]:
    """Two columns made comparable. A text met by another kind is read as that kind, and
    text that cannot be read becomes null instead of failing the job."""
    lk, rk = kind(left_type), kind(right_type)
    if lk == rk:
        return left, right
    if lk == "text":
        return _read_as(left, right_type), right
    if rk == "text":
        return left, _read_as(right, left_type)
    if {lk, rk} == {"number", "boolean"}:
        return left.cast("double"), right.cast("double")
    return left, right


def _read_as(text: Column, data_type: T.DataType) -> Column:
    """A text as the kind it is compared with. Beside whole numbers it must be one itself: nothing is rounded to meet a key."""
    if isinstance(data_type, T.IntegralType):
        whole = F.regexp_extract(text, WHOLE_TEXT, 1)
        return F.when(whole != "", whole).try_cast(T.DecimalType(38, 0))
    if is_floating(data_type):
        return text.try_cast(T.DoubleType())
    return text.try_cast(data_type)


def field_type(schema: T.StructType, name: str) -> T.DataType:
    return schema[name].dataType


def text_column(schema: T.StructType, name: str, side: str | None = None) -> Column:
    return text_of(col(name, side), field_type(schema, name))
