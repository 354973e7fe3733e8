"""A sorted result kept as a table of ranges, so that positions and deep pages need no task that sees everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.names import col, known_fields
from tributary.operators.view import Sort, ordering, sort_columns
from tributary.sources.folders import shared_folder

PART, AT = "__part", "__at"


class Ordered:
    """The rows of ``df`` in the order ``order_by``, nulls last both ways, written once below ``folder``.

    A range-partitioned sort writes a folder for each range, with each row's place in it. The driver knows how many rows each range has, a
    number for each partition: that gives the place of a row in the whole, and the ranges a page touches. Only these are read. Rows that are equal in all
    fields of ``order_by`` have some order, the same for every page. ``folder`` belongs to the caller; by default it is a new one in the shared folder. ``size`` is the number of rows.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[Sort], folder: str | None = None, partitions: int | None = None) -> None:
        order = sort_columns(order_by)
        if not order:
            raise ValueError("an order needs a field")
        known_fields(df, [n for n, _ in order], "error", "order")
        self.columns, self._order = df.columns, order
        self._folder = folder or shared_folder(df.sparkSession, "ordered")
        by = ordering(order)
        ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
        ranged = ranged.sortWithinPartitions(*by).withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
        ranged.write.partitionBy(PART).parquet(self._folder)
        self._rows = df.sparkSession.read.schema(ranged.schema).parquet(self._folder)
        counts = sorted((r[PART], r["count"]) for r in self._rows.groupBy(PART).count().collect())
        self._starts: list[tuple[int, int, int]] = []  # part, rows before it, rows in it
        self.size = 0
        for part, n in counts:
            self._starts.append((part, self.size, n))
            self.size += n

    def positions(self, name: str = "position") -> DataFrame:
        """All rows with their place, from 1, as column ``name``."""
        return self._placed(self._starts, name)

    def page(self, number: int, size: int) -> DataFrame:
        """Rows of page ``number`` (from 1), in order, from the ranges it touches."""
        if number < 1 or size < 0:
            raise ValueError("pages count from 1 and sizes are not negative")
        first, last = (number - 1) * size + 1, number * size
        touched = [x for x in self._starts if x[1] < last and x[1] + x[2] >= first]
        rows = self._placed(touched, AT).where(F.col(AT).between(first, last))
        return rows.orderBy(AT).select(*[col(c) for c in self.columns])

    def _placed(self, parts: Sequence[tuple[int, int, int]], name: str) -> DataFrame:
        spark = self._rows.sparkSession
        starts = spark.createDataFrame([x[:2] for x in parts], f"{PART} int, __before long")
        rows = self._rows.where(F.col(PART).isin([x[0] for x in parts])) if len(parts) < len(self._starts) else self._rows
        place = (F.col("__before") + F.col(AT) + 1).alias(name)
        return rows.join(F.broadcast(starts), PART).select(*[col(c) for c in self.columns], place)
