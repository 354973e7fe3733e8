"""Column and table names: quoting, qualifying, cleaning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that may not be used as a table name.
RESERVED_WORDS = frozenset(
    "select from where order group by join left right inner outer full on limit offset union "
    "distinct having as and or not null is like in table view".split()
)


def quote(name: str) -> str:
    """Backtick a name so that spaces, dots and hyphens in it are harmless."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str, side: str | None = None) -> Column:
    return F.col(f"{side}.{quote(name)}" if side else quote(name))


def bare(name: str) -> str:
    """Field name without its table prefix and quotes."""
    text = name.strip()
    if text[-1:] in '`"' and text[:1] == text[-1:] and text.count(text[-1]) == 2:
        return text[1:-1]
    return text.rsplit(".", 1)[-1].strip().strip('`"')


def clean_columns(df: DataFrame) -> DataFrame:
    """Trim column names and turn the spaces inside them into underscores."""
    return df.toDF(*[str(c).strip().replace(" ", "_") for c in df.columns])


def unique(names: Iterable[str]) -> list[str]:
    """Names in order of first mention."""
    return list(dict.fromkeys(n for n in names if n))


def table_name(name: str) -> str:
    """Table name from a file or user-given name: last extension dropped, reserved words refused."""
    stem, dot, _ = name.rpartition(".")
    base = (stem if dot and stem else name).strip() or "uploaded_table"
    if base.lower() in RESERVED_WORDS:
        raise ValueError(f"'{base}' is a reserved word and cannot name a table")
    return base


def known_fields(df: DataFrame, fields: Iterable[str], on_missing: str, what: str) -> list[str]:
    """Fields present in ``df``; absent ones are an error unless ``on_missing='pass'``."""
    have = set(df.columns)
    wanted = unique(fields)
    absent = [f for f in wanted if f not in have]
    if absent and on_missing == "error":
        raise ValueError(f"{what}: no such column {absent}; columns are {df.columns}")
    return [f for f in wanted if f in have]
