"""Declared field types with date formats, and cleaning of non-finite numbers."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import values as V
from tributary.functions.names import col

# Date formats offered for a field, and what Spark calls them.
DATE_FORMATS = {
    "YYYY-MM-DD": "yyyy-MM-dd",
    "YYYY/MM/DD": "yyyy/MM/dd",
    "DD-MM-YYYY": "dd-MM-yyyy",
    "DD/MM/YYYY": "dd/MM/yyyy",
    "MM/DD/YYYY": "MM/dd/yyyy",
    "YYYY-MM-DD HH:mm:ss": "yyyy-MM-dd HH:mm:ss",
    "YYYY/MM/DD HH:mm:ss": "yyyy/MM/dd HH:mm:ss",
}
ISO8601 = "ISO8601"
EPOCH_MILLIS = "Timestamp (ms)"


def spark_pattern(fmt: str) -> str:
    """Spark datetime pattern for a listed or custom format."""
    if fmt in DATE_FORMATS:
        return DATE_FORMATS[fmt]
    return re.sub(r"Y+|D+|A", lambda m: {"Y": "y", "D": "d", "A": "a"}[m[0][0]] * len(m[0]), fmt)


def typed(column: Column, data_type: T.DataType, declared: str, fmt: str | None = None) -> Column:
    """``column`` as the declared type. A value that cannot be read becomes null."""
    k = V.kind(data_type)
    match declared:
        case "string" | "json":
            return V.text_of(column, data_type)
        case "number":
            return column if k == "number" else column.cast("string").try_cast("double")
        case "boolean":
            return column if k == "boolean" else column.cast("string").try_cast("boolean")
        case "timestamp":
            return _moment(column, data_type, k, fmt)
        case "date":
            return column if k == "date" else _moment(column, data_type, k, fmt).cast("date")
    raise ValueError(f"unknown declared type '{declared}'")


def _moment(column: Column, data_type: T.DataType, k: str, fmt: str | None) -> Column:
    if k == "timestamp":
        return column
    if k == "date":
        return column.cast("timestamp")
    if fmt == EPOCH_MILLIS:
        return F.timestamp_millis(column.cast("string").try_cast("bigint"))
    if not fmt or fmt == ISO8601:
        return column.cast("string").try_cast("timestamp")
    return F.try_to_timestamp(column.cast("string"), F.lit(spark_pattern(fmt)))


def cast_fields(df: DataFrame, field_types: Mapping[str, Mapping[str, str] | str]) -> DataFrame:
    """Cast columns by ``{name: type}`` or ``{name: {"type":..., "format":...}}``; one projection."""
    unknown = [n for n in field_types if n not in df.columns]
    if unknown:
        raise ValueError(f"no such column {unknown}")
    out = []
    for field in df.schema:
        spec = field_types.get(field.name)
        if spec is None:
            out.append(col(field.name))
            continue
        spec = {"type": spec} if isinstance(spec, str) else spec
        out.append(typed(col(field.name), field.dataType, spec["type"], spec.get("format")).alias(field.name))
    return df.select(*out)


def clean_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinities in float columns become null, so that sums and tests skip them."""
    inf = float("inf")

    def clean(field: T.StructField) -> Column:
        c = col(field.name)
        if not isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            return c
        return F.when(~(F.isnan(c) | c.isin(inf, -inf)), c).alias(field.name)

    return df.select(*[clean(f) for f in df.schema])
