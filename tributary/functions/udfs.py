"""User functions: one row at a time, or a batch at a time."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.names import col

# Executors need not have this package installed: what it sends them travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])

_COERCE = {T.LongType: int, T.IntegerType: int, T.DoubleType: float, T.StringType: str, T.BooleanType: bool}


def row_function(fn: Callable[[dict], Any], return_type: str | T.DataType, fields: Sequence[str]) -> Column:
    """``fn(row dict) -> value`` over the named fields; a row it fails on gives null. Rows travel
    in Arrow batches. Name only the fields it reads, so that the scan reads no others."""
    data_type = T.DataType.fromDDL(return_type) if isinstance(return_type, str) else return_type
    coerce = _COERCE.get(type(data_type), lambda v: v)

    names = list(fields)

    def guarded(*cells):
        try:
            value = fn(dict(zip(names, map(_plain, cells))))
            return None if value is None else coerce(value)
        except Exception:
            return None

    return F.udf(guarded, data_type, useArrow=True)(*[col(f) for f in names])


def _plain(cell: Any) -> Any:
    return cell.asDict(recursive=True) if isinstance(cell, Row) else cell


def batch_function(
    fn: Callable[[pd.DataFrame], pd.Series], return_type: str | T.DataType, fields: Sequence[str]
) -> Column:
    """``fn(pandas frame of a batch) -> Series``: the fast form of a user function. It must treat
    rows independently, because a batch is an arbitrary slice of the table."""

    def run(batch: pd.DataFrame) -> pd.Series:
        return fn(batch)

    return F.pandas_udf(run, return_type)(F.struct(*[col(f) for f in fields]))
