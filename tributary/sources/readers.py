"""Reading CSV and Parquet tables, writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.casts import clean_nonfinite
from tributary.functions.names import clean_columns, col

# Cell texts that mean "no value" in a CSV file (the pandas reader's defaults).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# What a number and a whole number look like in a CSV cell.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
WHOLE = r"^\s*[+-]?\d+\s*$"


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str | T.StructType | None = None,
    null_tokens: Sequence[str] = NULL_TOKENS,
    multiline: bool = False,
) -> DataFrame:
    """CSV with a header row; quotes are doubled inside quoted cells.

    Give ``schema`` for large files: one read, no inference. Without it one extra pass decides
    between whole number, number, boolean and text for each column; dates stay text until
    ``cast_fields`` reads them. ``multiline`` allows line breaks inside quoted cells, at the price of
    unsplittable files. Where several files are read, those with one header line are read together, each by its own names, and
    united by name; a column that a file lacks is null there.
    """
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multiline}
    reader = spark.read.options(**options, inferSchema=False)
    groups = _by_header(spark, path)
    parts = [clean_columns(reader.csv(files)) for files in groups] if len(groups) > 1 else [clean_columns(reader.csv(path))]
    text = parts[0]
    for part in parts[1:]:
        text = text.unionByName(part, allowMissingColumns=True)
    text = text.select(*[_without_tokens(col(c), null_tokens).alias(c) for c in text.columns])
    if schema is not None:
        wanted = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
        return text.select(*[_read_as(col(f.name), f.dataType).alias(f.name) for f in wanted])
    found = _infer(text)
    return text.select(*[_read_as(col(c), found[c]).alias(c) for c in text.columns])


def _by_header(spark: SparkSession, path: str | Sequence[str]) -> list[list[str]]:
    """The files of a path, those with the same first line together, in the order of their names. The executors read the beginnings of the
    files; the driver sees a line for each file."""
    paths = [path] if isinstance(path, str) else list(path)
    if len(paths) == 1 and not _is_folder(spark, paths[0]):
        return [paths]
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    groups: dict[str, list[str]] = {}
    for file, header in sorted(first.collect()):
        groups.setdefault(header.strip().lstrip("\ufeff"), []).append(file)
    return list(groups.values()) or [paths]


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path may stand for several files."""
    if any(c in path for c in "*?[{"):
        return True
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return found.exists(where) and found.getFileStatus(where).isDirectory()


def _without_tokens(c: Column, tokens: Sequence[str]) -> Column:
    return F.when(~c.isin(list(tokens)), c) if tokens else c


def _read_as(c: Column, data_type: T.DataType) -> Column:
    return c if isinstance(data_type, T.StringType) else F.trim(c).try_cast(data_type)


def _infer(text: DataFrame) -> dict[str, T.DataType]:
    """Narrowest type every non-null cell of a column fits, found in one aggregation. Whole numbers too long for a long become
    decimals, and beyond these stay text: never doubles, which would lose digits."""

    def whole(c: Column, data_type: T.DataType) -> Column:
        return c.rlike(WHOLE) & F.trim(c).try_cast(data_type).isNotNull()

    types = (
        (T.LongType(), lambda c: whole(c, T.LongType())),
        (T.DecimalType(38, 0), lambda c: whole(c, T.DecimalType(38, 0))),
        (T.StringType(), lambda c: c.rlike(WHOLE)),
        (T.DoubleType(), lambda c: c.rlike(NUMBER)),
        (T.BooleanType(), lambda c: F.lower(c).isin("true", "false")),
    )
    tests = [F.bool_and(fits(col(c))).alias(f"{i}_{j}") for i, c in enumerate(text.columns) for j, (_, fits) in enumerate(types)]
    row = text.agg(*tests).first() if tests else ()
    out = {}
    for i, c in enumerate(text.columns):
        flags = row[i * len(types) : (i + 1) * len(types)]
        out[c] = next((t for (t, _), ok in zip(types, flags) if ok), T.StringType())
    return out


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Parquet with its own types; column names cleaned, non-finite numbers made null by
    ``clean_nonfinite`` when asked for."""
    paths = [path] if isinstance(path, str) else list(path)
    return clean_columns(spark.read.parquet(*paths))


def read_table(spark: SparkSession, path: str, finite: bool = False, **csv_options) -> DataFrame:
    """Read by file extension: csv, parquet or pq."""
    kind = path.lower().rstrip("/").rsplit(".", 1)[-1]
    if kind == "csv":
        df = read_csv(spark, path, **csv_options)
    elif kind in ("parquet", "pq"):
        df = read_parquet(spark, path)
    else:
        raise ValueError(f"unsupported file format '{path}'; CSV and Parquet are read")
    return clean_nonfinite(df) if finite else df


def write_csv(df: DataFrame, path: str) -> None:
    """The whole result as a directory of CSV files with headers, written by the executors."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)
