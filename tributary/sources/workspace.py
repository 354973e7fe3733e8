"""Named tables: register, replace, scan, preview, inventory, raw SQL, ingest log."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tributary.functions.casts import cast_fields
from tributary.functions.names import quote, table_name
from tributary.operators.view import Sort, page, preview
from tributary.sources.folders import shared_folder
from tributary.sources.readers import read_table

#: What a root knows: the folder each name stands for, null once it is dropped; the last row of a name counts.
MANIFEST_SCHEMA = "name string, path string, version long"
#: The field types declared for each name, as JSON; the last row of a name counts.
TYPES_SCHEMA = "name string, types string, version long"
FIELDS_SCHEMA = "table_name string, field string, stored string, declared string, format string"
LOG_SCHEMA = "loaded_at timestamp, file_name string, dataset_name string, table_name string, rows long"


class Workspace:
    """The tables of one user, each a Parquet folder or a DataFrame, each also a temporary view.

    Below a ``root`` that the caller names, saved tables last: a workspace opened there later has them again. Without
    one, a folder is taken when the first table is written.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self._root = root.rstrip("/") if root else None
        self._lasting = root is not None
        self._tables: dict[str, DataFrame] = {}
        self._types: dict[str, dict[str, dict[str, str]]] = self._declared()
        for row in self._versions():
            if row["path"]:
                self.attach(row["name"], spark.read.parquet(row["path"]))

    @property
    def root(self) -> str:
        if self._root is None:
            self._root = shared_folder(self.spark, "tables").rstrip("/")
        return self._root

    @property
    def _manifest(self) -> str:
        return f"{self.root}/_tables"

    def _files(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def _delete(self, path: str) -> None:
        system, found = self._files(path)
        system.delete(found, True)

    def _versions(self, name: str | None = None) -> list:
        """The last row of each name, or all rows of one, newest first."""
        if not self._lasting:
            return []
        system, found = self._files(self._manifest)
        if not system.exists(found):
            return []
        rows = self.spark.read.schema(MANIFEST_SCHEMA).parquet(self._manifest)
        if name is not None:
            return rows.where(F.col("name") == name).orderBy(F.desc("version")).collect()
        return rows.groupBy("name").agg(F.max_by("path", "version").alias("path")).collect()

    def _note(self, name: str, path: str | None) -> None:
        if self._lasting:
            row = self.spark.createDataFrame([(name, path, time.time_ns())], MANIFEST_SCHEMA)
            row.coalesce(1).write.mode("append").parquet(self._manifest)

    def _declared(self) -> dict[str, dict[str, dict[str, str]]]:
        if not self._lasting:
            return {}
        system, found = self._files(f"{self.root}/_types")
        if not system.exists(found):
            return {}
        rows = self.spark.read.schema(TYPES_SCHEMA).parquet(f"{self.root}/_types")
        return {r["name"]: json.loads(r["types"]) for r in rows.groupBy("name").agg(F.max_by("types", "version").alias("types")).collect()}

    def declare(self, name: str, field_types: Mapping[str, Mapping[str, str] | str]) -> None:
        """Keep what fields of a table mean: ``{field: type}`` or ``{field: {"type":..., "format":...}}``, in place of what was declared before.

        The stored table stays as it is; ``typed`` reads it so. Declarations belong to the name: they hold for whatever table it is given later, and below a
        lasting root for workspaces opened there later. Dropping the table drops them.
        """
        name = table_name(name)
        cast_fields(self.table(name), field_types)  # refuses unknown fields and types
        self._types[name] = {f: {"type": t} if isinstance(t, str) else dict(t) for f, t in field_types.items()}
        self._note_types(name)

    def _note_types(self, name: str) -> None:
        if self._lasting:
            row = self.spark.createDataFrame([(name, json.dumps(self._types.get(name, {})), time.time_ns())], TYPES_SCHEMA)
            row.coalesce(1).write.mode("append").parquet(f"{self.root}/_types")

    def typed(self, name: str) -> DataFrame:
        """A table with its fields as declared, one projection; a cell that cannot be read so is null. Declared fields that the table no longer has are left out."""
        df, types = self.table(name), self._types.get(name, {})
        return cast_fields(df, {f: t for f, t in types.items() if f in df.columns})

    def fields(self) -> DataFrame:
        """``(table_name, field, stored, declared, format)`` for each field of each table; without a declaration the last two are null."""
        found = []
        for name, df in self._tables.items():
            for f in df.schema:
                own = self._types.get(name, {}).get(f.name, {})
                found.append((name, f.name, f.dataType.simpleString(), own.get("type"), own.get("format")))
        return self.spark.createDataFrame(found, FIELDS_SCHEMA)

    def attach(self, name: str, df: DataFrame) -> str:
        """Make a DataFrame known under a name without writing it."""
        name = table_name(name)
        df.createOrReplaceTempView(quote(name))
        self._tables[name] = df
        return name

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Write a result as Parquet and (re)define the table. Each save goes to a folder of its own,
        so a table may be replaced by something computed from it, and readers of the old one finish. Below a lasting root the
        version before stays, older ones are deleted."""
        name = table_name(name)
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        saved = self.spark.read.parquet(path)
        self.attach(name, saved)
        self._note(name, path)
        for old in self._versions(name)[2:]:
            if old["path"]:
                self._delete(old["path"])
        return saved

    def ingest(self, path: str, name: str | None = None, **read_options) -> str:
        """Load a CSV or Parquet file as a table and log it. The row count comes from the write."""
        file_name = path.rstrip("/").rsplit("/", 1)[-1]
        dataset = name.strip() if name and name.strip() else file_name
        counted = Observation()
        df = read_table(self.spark, path, **read_options)
        self.save(dataset, df.observe(counted, F.count(F.lit(1)).alias("rows")))
        table = table_name(dataset)
        entry = self.spark.createDataFrame(
            [(file_name, dataset, table, counted.get["rows"])],
            "file_name string, dataset_name string, table_name string, rows long",
        )
        entry.select(F.current_timestamp().alias("loaded_at"), "*").write.mode("append").parquet(self._log)
        return table

    @property
    def _log(self) -> str:
        return f"{self.root}/_ingest_log"

    def ingest_log(self) -> DataFrame:
        """One row per load; needs at least one load."""
        return self.spark.read.schema(LOG_SCHEMA).parquet(self._log)

    def names(self) -> list[str]:
        return list(self._tables)

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise ValueError(f"unknown table '{name}'; tables are {self.names()}")
        return self._tables[name]

    def preview(self, name: str, rows: int = 50) -> DataFrame:
        return preview(self.table(name), rows)

    def drop(self, name: str) -> bool:
        """Forget a table, and delete what was written for it."""
        name = table_name(name)
        self.spark.catalog.dropTempView(name)
        known = self._tables.pop(name, None) is not None
        if known and self._root is not None:
            self._note(name, None)
            self._delete(f"{self.root}/{name}")
        if self._types.pop(name, None) is not None:
            self._note_types(name)
        return known

    def inventory(self) -> DataFrame:
        """``(table_name, row_count, column_count)`` for each table."""
        counts = [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(n).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count")
            )
            for n, df in self._tables.items()
        ]
        if not counts:
            return self.spark.createDataFrame([], "table_name string, row_count long, column_count int")
        return reduce(DataFrame.unionAll, counts)

    def sql(self, query: str, args: Mapping[str, Any] | None = None) -> DataFrame:
        """A query over the tables. Text that is not a query (DROP, INSERT ...) is a parse error."""
        text = query.strip().rstrip(";")
        return self.spark.sql(f"SELECT * FROM (\n{text}\n)", args=dict(args) if args else None)

    def sql_page(self, query: str, number: int, size: int, order_by: list[Sort], args=None, total: str | None = None) -> DataFrame:
        """One page of a query's result; the plan ends in the page, the rest is not fetched. ``total`` names a column for the
        row count of the whole result, which is counted on its own."""
        return page(self.sql(query, args), number, size, order_by, total)
