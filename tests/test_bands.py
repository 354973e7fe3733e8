"""Joins by ranges alone and best bounds, against loops over all pairs."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tributary import exists, join
from tributary.operators import band
from tributary.operators import join as joins

OPS = ("<", "<=", ">", ">=")


@pytest.fixture(autouse=True)
def always_cells(monkeypatch):
    monkeypatch.setattr(joins, "TINY", 0)
    monkeypatch.setattr(band, "ROWS_PER_CELL", 3)
    monkeypatch.setattr(band, "MOST_EDGES", 4)
    monkeypatch.setattr(band.axis_of, "__defaults__", (3, True))
    monkeypatch.setattr(band.in_cells, "__defaults__", (3,))
    monkeypatch.setattr(band.best_bounds, "__defaults__", (3,))


def above(a, b):
    """Spark's order: NaN is the largest."""
    return (math.isnan(a), a if not math.isnan(a) else 0) > (math.isnan(b), b if not math.isnan(b) else 0)


def holds(a, op, b):
    if a is None or b is None:
        return False
    gt, lt = above(a, b), above(b, a)
    return {"<": lt, "<=": not gt, ">": gt, ">=": not lt}[op]


def sides(spark, seed=1):
    rng = random.Random(seed)
    numbers = [*range(12), 5, 5, 5, None, float("nan"), float("inf"), 2.5]
    pick = lambda: None if (x := rng.choice(numbers)) is None else float(x)
    left = [(i, pick(), pick()) for i in range(60)]
    right = [(i, pick(), pick()) for i in range(50)]
    return left, right, spark.createDataFrame(left, "id long, x double, u double"), spark.createDataFrame(right, "rid long, lo double, hi double")


def paired(left, right, how, test):
    pairs = [(a, b) for a in left for b in right if test(a, b)]
    out = [(*a, *b) for a, b in pairs]
    if how in ("left", "full"):
        out += [(*a, None, None, None) for a in left if a not in [p for p, _ in pairs]]
    if how in ("right", "full"):
        out += [(None, None, None, *b) for b in right if b not in [p for _, p in pairs]]
    return sorted(map(repr, out))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize(
    ("on", "test"),
    [
        ("x >= lo AND x < hi", lambda a, b: holds(a[1], ">=", b[1]) and holds(a[1], "<", b[2])),
        ("lo > x AND lo <= u", lambda a, b: holds(b[1], ">", a[1]) and holds(b[1], "<=", a[2])),
        ("x < lo", lambda a, b: holds(a[1], "<", b[1])),
        ("x > lo AND u < lo", lambda a, b: holds(a[1], ">", b[1]) and holds(a[2], "<", b[1])),
        ("l.x BETWEEN r.lo AND r.hi AND l.id + r.rid > 40", lambda a, b: holds(a[1], ">=", b[1]) and holds(a[1], "<=", b[2]) and a[0] + b[0] > 40),
    ],
)
def test_range_joins(spark, how, on, test):
    left, right, l, r = sides(spark)
    got = join(l, r, on, how, left_names=["l"], right_names=["r"])
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    want = paired(left, right, how, test)
    assert sorted(repr(tuple(x)) for x in got.collect()) == want


def test_dates_times_and_whole_numbers(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in (0, 3, 3, 40, 41)]
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in (1, 5, 30, 900)]
    for kind, values in (("date", days), ("timestamp", times), ("long", [1, 2**60, 2**60 + 1, -5, 7]), ("decimal(20,2)", None)):
        values = values or [__import__("decimal").Decimal(x) for x in ("1.10", "2.25", "99999999999.99")]
        l = spark.createDataFrame([(v,) for v in values], f"x {kind}")
        got = join(l, l.select(F.col("x").alias("y")), "x > y", "inner").collect()
        assert sorted(map(tuple, got)) == sorted((a, b) for a in values for b in values if a > b)


def test_no_rows_and_hot_value(spark):
    _, _, l, r = sides(spark)
    assert join(l.limit(0), r, "x < lo", "inner").count() == 0 == join(l, r.limit(0), "x >= lo AND x <= hi", "inner").count()
    assert join(l, r.limit(0), "x >= lo AND x <= hi", "left").count() == 60
    same = spark.range(3000).select(F.lit(7.0).alias("x"))
    spans = spark.range(20).select((F.col("id") % 10).cast("double").alias("lo"), F.lit(8.0).alias("hi"))
    assert join(same, spans, "x >= lo AND x < hi", "inner").count() == 3000 * 16


def test_outer_join_with_text_beside_its_keys_is_split(spark):
    l = spark.createDataFrame([(i % 3, i) for i in range(30)] + [(None, 1)], "k long, a long")
    r = spark.createDataFrame([(i % 4, i) for i in range(20)] + [(None, 2)], "k2 long, b long")
    for how in ("left", "right", "full"):
        plain, guarded = (join(l, r, "k = k2 AND a + b > 30", how, spread=s) for s in (False, True))
        assert sorted(map(repr, map(tuple, plain.collect()))) == sorted(map(repr, map(tuple, guarded.collect())))


def test_names_that_differ_in_case(spark):
    l, r = spark.createDataFrame([(1, 2)], "id long, Value long"), spark.createDataFrame([(1, 3)], "rid long, value long")
    assert join(l, r, "id = rid", "inner").columns == ["id", "Value", "rid", "value_joined"]


@pytest.mark.parametrize(("op1", "op2"), [*itertools.product(OPS, OPS)])
@pytest.mark.parametrize("keyed", [True, False])
def test_exists_with_two_bounds(spark, op1, op2, keyed):
    left, right, sub, main = sides(spark, 4)
    conditions = [{"field": "x", "operator": op1, "mainField": "lo"}, {"field": "u", "operator": op2, "mainField": "hi"}]
    sub, main = sub.withColumn("k", F.col("id") % 3), main.withColumn("mk", F.col("rid") % 4)
    if keyed:
        conditions.append({"field": "k", "operator": "=", "mainField": "mk"})
    got = exists(sub, main, tree={"logicalOperator": "AND", "conditions": conditions})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sorted(a[0] for a in left if any(holds(a[1], op1, b[1]) and holds(a[2], op2, b[2]) and (not keyed or a[0] % 3 == b[0] % 4) for b in right))
    assert sorted(r.id for r in got.collect()) == want


def test_exists_or_per_key(spark):
    left, right, sub, main = sides(spark, 9)
    sub, main = sub.withColumn("k", F.col("id") % 3), main.withColumn("mk", F.col("rid") % 4)
    tree = {"logicalOperator": "AND", "conditions": [
        {"field": "k", "operator": "=", "mainField": "mk"},
        {"logicalOperator": "OR", "type": "group", "conditions": [
            {"field": "x", "operator": "<", "mainField": "lo"},
            {"field": "x", "operator": ">", "mainField": "hi"},
            {"field": "id", "operator": "=", "mainField": "rid"},
            {"logicalOperator": "AND", "type": "group", "conditions": [{"field": "x", "operator": ">=", "mainField": "lo"}, {"field": "u", "operator": "<", "mainField": "hi"}]},
        ]},
    ]}
    got = exists(sub, main, tree=tree)
    want = sorted(
        a[0] for a in left if any(a[0] % 3 == b[0] % 4 and (holds(a[1], "<", b[1]) or holds(a[1], ">", b[2]) or a[0] == b[0] or holds(a[1], ">=", b[1]) and holds(a[2], "<", b[2])) for b in right)
    )
    assert sorted(r.id for r in got.collect()) == want


def test_hot_key_is_linear(spark):
    sub = spark.range(20_000).select(F.lit(1).alias("k"), F.rand(1).alias("x"), F.rand(2).alias("u"))
    main = spark.range(20_000).select(F.lit(1).alias("mk"), (F.rand(3) + 0.9).alias("lo"), (F.rand(4) * 0.1).alias("hi"))
    conditions = [{"field": "k", "operator": "=", "mainField": "mk"}, {"field": "x", "operator": ">", "mainField": "lo"}, {"field": "u", "operator": "<", "mainField": "hi"}]
    got = {(r.x, r.u) for r in exists(sub, main, tree={"conditions": conditions}).collect()}
    points = sorted((r.lo, r.hi) for r in main.collect())
    best, at, want = -1.0, 0, set()
    for x, u in sorted((r.x, r.u) for r in sub.collect()):
        while at < len(points) and points[at][0] < x:
            best, at = max(best, points[at][1]), at + 1
        if u < best:
            want.add((x, u))
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_times_without_a_zone(spark, how):
    """Times that New York skips or has twice, and some before 1970."""
    days = [dt.datetime(1969, 12, 31, 23), dt.datetime(2024, 3, 10, 1, 30), dt.datetime(2024, 11, 3, 0, 45)]
    times = [d + dt.timedelta(minutes=20 * i, microseconds=i) for d in days for i in range(9)] + [None]
    left = [(i, t) for i, t in enumerate(times)]
    right = [(i, t and t + dt.timedelta(microseconds=i % 3 - 1), t and t + dt.timedelta(hours=1)) for i, t in enumerate(times)]
    l = spark.createDataFrame(left, "id long, x timestamp_ntz")
    r = spark.createDataFrame(right, "rid long, lo timestamp_ntz, hi timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = join(l, r, "x >= lo AND x < hi", how)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = sorted(repr(tuple(x)) for x in got.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    pairs = [(a, b) for a in left for b in right if None not in (a[1], b[1]) and b[1] <= a[1] < b[2]]
    want = [(*a, *b) for a, b in pairs]
    want += [(*a, None, None, None) for a in left if how in ("left", "full") and a not in [p for p, _ in pairs]]
    want += [(None, None, *b) for b in right if how in ("right", "full") and b not in [p for _, p in pairs]]
    assert rows == sorted(map(repr, want))


def test_copied_side_is_never_broadcast(spark):
    """Spark's estimate of a side that is copied to its cells knows nothing of the copies: 40 rows, each over 500 cells."""
    points = spark.range(1500).select((F.col("id") % 500).cast("double").alias("x"))
    spans = spark.range(40).select((F.col("id") - 20).cast("double").alias("lo"), (F.col("id") + 490).cast("double").alias("hi"))
    for how in ("inner", "left", "right", "full"):
        got = join(points, spans, "x >= lo AND x <= hi", how)
        counted = got.agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("lo").alias("lo"))
        pairs = [(x, i - 20) for x in range(500) for i in range(40) if i - 20 <= x <= i + 490]
        alone = [x for x in range(500) if not any(i - 20 <= x <= i + 490 for i in range(40))] if how in ("left", "full") else []
        assert tuple(counted.first()) == (3 * len(pairs) + 3 * len(alone), 3 * (sum(x for x, _ in pairs) + sum(alone)), 3 * sum(lo for _, lo in pairs))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Generate" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin Inner" not in plan


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("on", ["x >= lo AND x < hi", "lo > x AND lo <= u"])
def test_points_broadcast_beside_a_large_side(spark, how, on, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: True)
    monkeypatch.setattr(joins, "known_large", lambda df, least: True)
    left, right, l, r = sides(spark, 6)
    between = (lambda a, b: holds(a[1], ">=", b[1]) and holds(a[1], "<", b[2])) if on.startswith("x") else (lambda a, b: holds(b[1], ">", a[1]) and holds(b[1], "<=", a[2]))
    assert sorted(repr(tuple(x)) for x in join(l, r, on, how).collect()) == paired(left, right, how, between)
