"""Joins by ranges alone, and the best bound per key: an axis is cut into cells, so that ranges become equal keys.

The edges of the cells are numbers the driver has before the plan is built (MOST_EDGES at most), so that both sides of a join, and every retry of
a task, use the same. Which edges they are doesn't change a result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import values as V
from tributary.functions.links import FLIPPED
from tributary.functions.names import col

MOST_EDGES, ROWS_PER_CELL = 1024, 1000
UP, DOWN = (">", ">="), ("<", "<=")
CELL = "__cell"


@dataclass(frozen=True)
class Axis:
    """``edges`` part the axis; each part but the outer two is cut into ``pieces`` of equal width."""

    edges: tuple[float, ...]
    pieces: int

    @property
    def last(self) -> int:
        return (len(self.edges) + 1) * self.pieces - 1

    def placed(self, df: DataFrame, value: Column, name: str) -> DataFrame:
        """``df`` with the number of the cell of ``value``, which grows with the value; NaN is the largest, null has none."""
        raw, part = f"{name}_value", f"{name}_part"
        df = df.withColumn(raw, value)
        if not self.edges:
            df = df.withColumn(part, F.lit(0))
        else:
            splits = [float("-inf"), *self.edges, float("inf")]
            cut = Bucketizer(splits=splits, inputCol=raw, outputCol=part, handleInvalid="keep")
            df = cut.transform(df.withColumn(raw, F.coalesce(raw, F.lit(float("nan"))))).withColumn(raw, value)
        x, at = F.col(raw), F.col(part).cast("int")
        cell = at.cast("long") * self.pieces
        if self.pieces > 1 and len(self.edges) > 1:
            edges = F.array(*map(F.lit, self.edges))
            low, high = F.get(edges, at - 1), F.get(edges, at)
            share = F.least(F.floor((x - low) / (high - low) * self.pieces), F.lit(self.pieces - 1))
            cell = cell + F.coalesce(F.when(at.between(1, len(self.edges) - 1), F.greatest(share, F.lit(0))), F.lit(0))
        cell = F.when(F.isnan(x), F.lit(self.last)).otherwise(cell).cast("long")
        return df.withColumn(name, F.when(x.isNotNull(), cell)).drop(raw, part)


def axis_of(values: DataFrame, rows_per_cell: int = ROWS_PER_CELL, even: bool = True) -> Axis:
    """An axis for the one column of ``values``, doubles: cells of about ``rows_per_cell`` rows. Beyond MOST_EDGES of them, they are cut evenly, if ``even``."""
    x = F.col(values.columns[0])
    shares = [i / MOST_EDGES for i in range(1, MOST_EDGES)]
    found = values.where(x.isNotNull() & ~F.isnan(x)).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(x, shares, 8 * MOST_EDGES).alias("q")).first()
    wanted = found["n"] // max(1, rows_per_cell)
    step = max(1, MOST_EDGES // max(1, wanted))
    edges = tuple(sorted({q for q in (found["q"] or [])[step - 1 :: step] if q not in (float("inf"), float("-inf"))})) if wanted > 1 else ()
    return Axis(edges, max(1, -(-wanted // MOST_EDGES)) if even else 1)


def on_axis(value: Column, data_type: T.DataType) -> Column | None:
    """A column as a double that grows with it; None where there is none."""
    kind = V.kind(data_type)
    if kind == "number":
        return value.cast("double")
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(data_type, T.TimestampNTZType):
        # Read off the clock: as an instant it would follow the session's time zone, whose hours may be skipped or come twice.
        clock = F.hour(value) * 3600 + F.minute(value) * 60 + F.extract(F.lit("SECOND"), value)
        return F.unix_date(value.cast("date")).cast("double") * 86400 + clock.cast("double")
    return F.unix_date(value).cast("double") if kind == "date" else None


Terms = Sequence[tuple[str, str, str]]


@dataclass(frozen=True)
class Band:
    """A column of one side, ``point``, with the other side's columns that bound it from below and above."""

    point: str
    of_left: bool
    lows: tuple[str, ...]
    highs: tuple[str, ...]


def find_band(left: T.StructType, right: T.StructType, terms: Terms, prefer_left: bool = True) -> Band | None:
    """The column best bounded by ``terms``: on both ends rather than on one."""
    found = []
    for of_left, own, other in ((True, left, right), (False, right, left)):
        turned = [(a, op, b) if of_left else (b, FLIPPED[op], a) for a, op, b in terms]
        for point in dict.fromkeys(a for a, _, _ in turned):
            kind = own[point].dataType

            def fits(b: str) -> bool:
                return on_axis(F.lit(None), kind) is not None and (V.kind(kind) == "number" == V.kind(other[b].dataType) or kind == other[b].dataType)

            lows = tuple(b for a, op, b in turned if a == point and op in UP and fits(b))
            highs = tuple(b for a, op, b in turned if a == point and op in DOWN and fits(b))
            if lows or highs:
                found.append(((bool(lows and highs), of_left == prefer_left), Band(point, of_left, lows, highs)))
    return max(found, key=lambda x: x[0])[1] if found else None


def in_cells(left: DataFrame, right: DataFrame, band: Band, rows_per_cell: int = ROWS_PER_CELL) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column CELL: rows of the point's side stand in one cell, the others are copied to all cells they span, so
    two rows that the bounds allow meet in exactly one cell. Copies are as many as the pairs they lead to, but for a share of one to ``rows_per_cell``."""
    points, spans = (left, right) if band.of_left else (right, left)
    value = on_axis(col(band.point), points.schema[band.point].dataType)
    axis = axis_of(points.select(value.alias("x")), rows_per_cell)
    points = axis.placed(points, value, CELL)

    def bound(names: Sequence[str], pick) -> Column:
        columns = [on_axis(col(b), spans.schema[b].dataType) for b in names]
        return pick(*columns) if len(columns) > 1 else columns[0]

    columns = spans.columns
    # A bound that is null allows no pair.
    for b in (*band.lows, *band.highs):
        spans = spans.where(col(b).isNotNull())
    spans = axis.placed(spans, bound(band.lows, F.greatest), "__from") if band.lows else spans.withColumn("__from", F.lit(0).cast("long"))
    spans = axis.placed(spans, bound(band.highs, F.least), "__to") if band.highs else spans.withColumn("__to", F.lit(axis.last).cast("long"))
    cells = F.explode(F.sequence("__from", "__to")).alias(CELL)
    spans = spans.where(F.col("__from") <= F.col("__to")).select(*[col(c) for c in columns], cells)
    return (points, spans) if band.of_left else (spans, points)


def best_bounds(
    main: DataFrame, sub: DataFrame, keys: Sequence[tuple[str, str]], first: tuple[str, str, str], second: tuple[str, str, str], rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """(k0, k1, ..., x, best): for each key and each value x of ``first``'s field in ``sub``, the extreme of ``second``'s main field among
    the main rows with that key that ``first`` links x to.

    ``keys`` are (sub field, main field); ``first`` and ``second`` are (sub field, op, main field) with op one of ``< <= > >=``. Main rows stand in order
    as steps, one for each key and value; asked values stand among them, and a running extreme goes along. A key's steps are cut into
    cells of the axis: what earlier cells have is found from one row for each key and cell, so no key is one task's work.
    """
    (x, op1, m1), (_, op2, m2) = first, second
    names = [f"k{i}" for i in range(len(keys))]
    upward = op1 in UP
    extreme, pick = (F.min, F.least) if op2 in UP else (F.max, F.greatest)
    main = main.where(col(m1).isNotNull() & col(m2).isNotNull())
    steps = main.groupBy(*[col(m).alias(n) for (_, m), n in zip(keys, names)], col(m1).alias("v")).agg(extreme(col(m2)).alias("y"))
    asked = sub.select(*[col(s).alias(n) for (s, _), n in zip(keys, names)], col(x).alias("v")).where(F.col("v").isNotNull()).distinct()
    # With equal values, a step counts for <= and >= and not for < and >.
    late = op1 in (">", "<")
    rows = steps.select(*names, "v", F.lit(int(late)).alias("side"), "y").unionAll(asked.select(*names, "v", F.lit(int(not late)).alias("side"), F.lit(None).cast(main.schema[m2].dataType)))
    for n in names:
        rows = rows.where(F.col(n).isNotNull())
    kind = rows.schema["v"].dataType
    axis = axis_of(main.select(on_axis(col(m1), main.schema[m1].dataType).alias("x")), rows_per_cell, even=False)
    rows = axis.placed(rows, on_axis(F.col("v"), kind), CELL)
    order = F.col("v").asc() if upward else F.col("v").desc()
    along = Window.partitionBy(*names, CELL).orderBy(order, "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("inside", extreme("y").over(along)).where(F.col("side") == int(not late))
    cells = rows.groupBy(*names, CELL).agg(extreme("y").alias("y"))
    cell_order = F.col(CELL).asc() if upward else F.col(CELL).desc()
    earlier = Window.partitionBy(*names).orderBy(cell_order).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*[F.col(n).alias(f"c{n}") for n in names], F.col(CELL).alias("of"), extreme("y").over(earlier).alias("before"))
    test = F.col(CELL) == F.col("of")
    for n in names:
        test = test & (F.col(n) == F.col(f"c{n}"))
    best = pick("inside", "before").alias("best")
    return inside.join(cells, test).select(*names, F.col("v").alias("x"), best).where(F.col("best").isNotNull())
