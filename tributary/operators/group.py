"""Group and aggregate.

Every metric here is merged from partial results before and after the shuffle, so a key holding a
third of the rows is no heavier than another. Exact medians take two passes for the same
reason, instead of collecting a group's values; the way is the same for every size of input. NaN counts as no value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import values as V
from tributary.functions.names import col, known_fields
from tributary.functions.predicates import all_of, any_of, condition, filled, resolve
from tributary.functions.sizing import fits_broadcast
from tributary.operators import skew
from tributary.operators.view import Sort, sort_columns

# Rank error of the first pass is n / ACCURACY; the second pass looks at twice that on both sides.
ACCURACY = 20_000
#: Cells between the bounds of a median.
CELLS = 256
MEDIANS = ("median", "quantile")
ORDERED = ("first", "last")


def _spread(central: Column, n: Column) -> Column:
    return F.when(n > 1, central)


METRICS = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "avg": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "std": lambda c: _spread(F.stddev_samp(c), F.count(c)),
    "var": lambda c: _spread(F.var_samp(c), F.count(c)),
    "sem": lambda c: _spread(F.stddev_samp(c), F.count(c)) / F.sqrt(F.count(c)),
    "nunique": F.count_distinct,
    "prod": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
    "size": lambda c: F.count(F.lit(1)),
    "any": lambda c: F.coalesce(F.bool_or(c.cast("boolean")), F.lit(False)),
    "all": lambda c: F.coalesce(F.bool_and(c.cast("boolean")), F.lit(True)),
}


def normal_metrics(metrics: Sequence[Mapping[str, Any] | tuple]) -> list[tuple[str | None, str, str]]:
    """(field or None, function, alias) for each metric; ``*`` or no field counts rows."""
    out = []
    for m in metrics:
        func, field, alias = (m.get("func"), m.get("field"), m.get("alias")) if isinstance(m, Mapping) else m
        field = None if field in (None, "", "*") else field
        func = func or "count"
        out.append((field, func, alias or f"{func}_{field or 'all'}"))
    return out


def group(
    df: DataFrame,
    keys: Sequence[str] = (),
    metrics: Sequence[Mapping[str, Any] | tuple] = (),
    having: Sequence[Mapping[str, Any]] = (),
    order_by: Sequence[Sort] = (),
    keep_null_groups: bool = False,
    sort_keys: bool = False,
    variables: Mapping[str, Any] | None = None,
    on_missing: str = "error",
) -> DataFrame:
    """Aggregate ``metrics`` (records ``{field, func, alias}`` or tuples ``(func, field, alias)``).

    Rows with a null key are dropped unless ``keep_null_groups``. Without keys there is one row;
    without metrics, the distinct keys. ``first`` / ``last`` take the first or last non-null value in
    the order ``order_by``. ``having`` is a list of conditions on output columns, all of which must
    hold. ``sort_keys`` orders the result by its keys.
    """
    keys = known_fields(df, keys, on_missing, "group")
    wanted = normal_metrics(metrics)
    if not keys and not wanted:
        return df
    present = set(known_fields(df, [f for f, _, _ in wanted if f], on_missing, "group"))
    wanted = [w for w in wanted if w[0] is None or w[0] in present]
    rows = df if keep_null_groups or not keys else df.where(filled(df.schema, keys))
    if not wanted:
        out = rows.select(*[col(k) for k in keys]).distinct()
    else:
        out = _aggregate(rows, keys, wanted, order_by, keep_null_groups)
    out = _having(out, having, variables or {}, on_missing)
    if sort_keys and keys:
        out = out.orderBy(*[col(k).asc_nulls_last() for k in keys])
    return out


def _aggregate(
    rows: DataFrame, keys: Sequence[str], wanted: Sequence[tuple], order_by: Sequence[Sort], null_keys: bool
) -> DataFrame:
    plain, medians = [], []
    for field, func, alias in wanted:
        if field is None:
            if func not in ("count", "size"):
                raise ValueError(f"'{func}' needs a field; only rows can be counted without one")
            plain.append(F.count(F.lit(1)).alias(alias))
        elif func in MEDIANS:
            if V.kind(V.field_type(rows.schema, field)) != "number":
                raise ValueError(f"'{func}' needs numbers; '{field}' is {V.field_type(rows.schema, field).simpleString()}")
            medians.append((field, alias))
        elif func in ORDERED:
            plain.append(_edge(rows, field, func, order_by).alias(alias))
        elif func in METRICS:
            plain.append(METRICS[func](_value(rows, field)).alias(alias))
        else:
            raise ValueError(f"unknown aggregate function '{func}'")
    if not medians:
        out = rows.groupBy(*[col(k) for k in keys]).agg(*plain)
        return out.select(*[col(k) for k in keys], *[col(alias) for _, _, alias in wanted])
    return _with_medians(rows, keys, plain, medians, null_keys).select(*[col(k) for k in keys], *[col(alias) for _, _, alias in wanted])


def _with(out: DataFrame, more: DataFrame, keys: Sequence[str], aliases: Sequence[str], null_keys: bool) -> DataFrame:
    if not keys:
        return out.crossJoin(F.broadcast(more))  # one row each
    test = skew.key_test([(k, k) for k in keys], "a", "b", null_keys)
    joined = out.alias("a").join(more.alias("b"), test, "left")
    return joined.select(*[col(c, "a") for c in out.columns], *[col(a, "b") for a in aliases])


def _value(rows: DataFrame, field: str) -> Column:
    """A cell whose NaN is null."""
    c = col(field)
    return F.when(~F.isnan(c), c) if V.is_floating(V.field_type(rows.schema, field)) else c


def _edge(rows: DataFrame, field: str, func: str, order_by: Sequence[Sort]) -> Column:
    order = sort_columns(order_by)
    if not order:
        raise ValueError(f"'{func}' needs order_by: a table has no row order of its own")
    known_fields(rows, [n for n, _ in order], "error", func)
    if len({asc for _, asc in order}) > 1:
        raise ValueError(f"'{func}' needs one direction for all order_by fields")
    # Ties in the order are settled by the value, so that the answer is the same on every run.
    cell = _value(rows, field)
    rank = F.struct(*[col(n) for n, _ in order], cell.alias("value"))
    pick = F.min_by if (func == "first") == order[0][1] else F.max_by
    return pick(cell, F.when(cell.isNotNull(), rank))


def median(
    rows: DataFrame, keys: Sequence[str], field: str, alias: str, null_keys: bool = False, accuracy: int = ACCURACY
) -> DataFrame:
    """Exact median per key, one row per key that has values; without keys one row."""
    out = _with_medians(rows, keys, [], [(field, alias)], null_keys, accuracy)
    return (out.where(col(alias).isNotNull()) if keys else out).select(*[col(k) for k in keys], col(alias))


def _with_medians(
    rows: DataFrame, keys: Sequence[str], plain: Sequence[Column], medians: Sequence[tuple[str, str]], null_keys: bool, accuracy: int = ACCURACY
) -> DataFrame:
    """The aggregates ``plain`` and exact medians ``(field, alias)`` per key, without gathering a key's values.

    One pass makes the aggregates and, with a mergeable quantile sketch for each field, a value surely below and one surely above each
    median. In a second pass equal values are counted together, everything below the lower bound as one number. What lies between the bounds is cut into
    CELLS cells of equal width; sums of the cells, that many for each key, show which one or two hold the middle ranks, and only their
    distinct values are ranked. Fields of one type share the second pass.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    fields = list(dict.fromkeys(f for f, _ in medians))
    margin = 2.0 / accuracy
    sketches = []
    for i, field in enumerate(fields):
        x = _value(rows, field)
        sketches.append(F.count(x).alias(f"__n{i}"))
        # Doubles keep the order, which is all that the bounds need; the sketch itself works on them.
        sketches.append(F.percentile_approx(x.cast("double"), [0.5 - margin, 0.5 + margin], accuracy).alias(f"__b{i}"))
    out = rows.groupBy(*[col(k).alias(n) for k, n in zip(keys, names)]).agg(*plain, *sketches)
    by_type: dict[str, list[int]] = {}
    for i, field in enumerate(fields):
        by_type.setdefault(V.field_type(rows.schema, field).simpleString(), []).append(i)
    result = out
    for own in by_type.values():
        found = _middles(rows, keys, names, fields, own, out, null_keys)
        result = _with(result, found, names, [f"__m{i}" for i in own], null_keys)
    return result.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)],
        *[col(c) for c in result.columns if not c.startswith("__")],
        *[F.col(f"__m{fields.index(field)}").alias(alias) for field, alias in medians],
    )


def _middles(rows: DataFrame, keys, names, fields, own: Sequence[int], bounds: DataFrame, null_keys: bool) -> DataFrame:
    """(keys, __m0, ...): the medians of the fields ``own``, all of one type."""
    data_type = V.field_type(rows.schema, fields[own[0]])
    values = [F.struct(F.lit(i).alias("f"), _value(rows, fields[i]).alias("v")) for i in own]
    data = rows.select(*[col(k).alias(n) for k, n in zip(keys, names)], F.explode(F.array(*values)).alias("__of"))
    data = data.select(*names, F.col("__of.f").alias("__f"), F.col("__of.v").alias("__x")).where("__x IS NOT NULL")
    ends = [F.struct(F.lit(i).alias("f"), F.col(f"__n{i}").alias("n"), F.col(f"__b{i}").alias("b")) for i in own]
    sent = bounds.select(*names, F.create_map(*[part for i, end in zip(own, ends) for part in (F.lit(i), end)]).alias("__ends"))
    if names:
        pairs = [(n, n) for n in names]
        if fits_broadcast(data):
            met = sent.alias("t1").join(data.alias("t2"), skew.key_test(pairs, "t1", "t2", null_keys))
        else:
            met = skew.left_outer(sent, data, pairs, null_keys)  # every key has rows
        near = met.select(*[F.col(f"t1.{n}").alias(n) for n in names], "t2.__f", "t2.__x", F.element_at("t1.__ends", F.col("t2.__f")).alias("__e"))
        near = near.where("__x IS NOT NULL")
    else:
        near = data.crossJoin(F.broadcast(sent)).select("__f", "__x", F.element_at("__ends", F.col("__f")).alias("__e"))  # one row
    low, high = F.element_at("__e.b", 1), F.element_at("__e.b", 2)
    near_x = F.col("__x").cast("double")
    inside = near_x >= low
    cell = F.least(F.floor((near_x - low) / F.when(high > low, high - low) * CELLS), F.lit(CELLS - 1))
    near = near.where(near_x <= high).select(
        *names, "__f", F.col("__e.n").alias("__n"), F.when(inside, F.coalesce(cell, F.lit(0))).otherwise(-1).cast("int").alias("__cell"), F.when(inside, F.col("__x")).alias("__v")
    )
    at = [*names, "__f", "__n"]
    counted = near.groupBy(*at, "__cell", "__v").agg(F.count(F.lit(1)).alias("__c"))
    middle = [F.floor((F.col("__n") + 1) / 2), F.floor((F.col("__n") + 2) / 2)]

    def holding(df: DataFrame, upto: Column) -> DataFrame:
        """Rows whose running count ``__r`` reaches a middle rank that the row before doesn't."""
        ranked = df.withColumn("__r", upto)
        return ranked.where(any_of((F.col("__r") >= m) & (F.col("__r") - F.col("__c") < m) for m in middle))

    running = (Window.unboundedPreceding, Window.currentRow)
    cells = counted.groupBy(*at, "__cell").agg(F.sum("__c").alias("__c"))
    cells = holding(cells, F.sum("__c").over(Window.partitionBy(*at).orderBy("__cell").rowsBetween(*running)))
    cells = cells.select(*[F.col(c).alias(f"{c}_of") for c in (*at, "__cell")], (F.col("__r") - F.col("__c")).alias("__before"))
    same = all_of(F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in (*at, "__cell"))
    few = counted.join(cells, same).select(*counted.columns, "__before")
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*at, "__cell").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(*running))
    found = holding(few, upto).groupBy(*names)
    out = []
    for i in own:
        least, most = (pick(F.when(F.col("__f") == i, F.col("__v"))) for pick in (F.min, F.max))
        if isinstance(data_type, T.DecimalType):
            value = ((least + most) / 2).cast("double")
        else:  # halves first: the sum of two large values may overflow
            value = least.cast("double") / 2 + most.cast("double") / 2
        out.append(value.alias(f"__m{i}"))
    return found.agg(*out)


def _having(out: DataFrame, having: Sequence[Mapping[str, Any]], variables: Mapping[str, Any], on_missing: str):
    tests = []
    for h in having:
        name = h.get("metricAlias") or h.get("field")
        value = resolve(h.get("value"), h.get("valueType"), variables, on_missing)
        numeric = name in out.columns and V.kind(V.field_type(out.schema, name)) == "number"
        number = V.as_number(value) if numeric and not isinstance(value, (list, DataFrame)) else None
        if h.get("operator") == "contains" and not isinstance(value, list):
            value = [str(value)]  # one text, commas and all
        elif number is not None:
            value = number
        record = {"field": name, "operator": h.get("operator"), "value": value}
        tests.append(condition(out.schema, record, variables, on_missing))
    return out.where(all_of(tests)) if tests else out
