"""Aggregates, medians, HAVING and branch overlap."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tributary import group, median, overlap
from tributary.operators import skew

ROWS = [("a", 1, 2.0), ("a", None, 4.0), ("b", None, None), ("b", None, 1.0), (None, 5, 9.0), ("c", 7, 0.5)]
SCHEMA = "k string, n long, x double"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_null_rules(frame):
    metrics = [("sum", "n", "s"), ("mean", "n", "m"), ("count", "n", "c"), ("count", "*", "all"), ("min", "x", "lo"), ("max", "x", "hi")]
    assert rows(group(frame, ["k"], metrics)) == [
        ("a", 1, 1.0, 1, 2, 2.0, 4.0),
        ("b", 0, None, 0, 2, 1.0, 1.0),
        ("c", 7, 7.0, 1, 1, 0.5, 0.5),
    ]
    assert group(frame, ["k"], metrics, keep_null_groups=True).count() == 4
    assert rows(group(frame, [], metrics)) == [(13, 13 / 3, 3, 6, 0.5, 9.0)]


def test_other_functions(frame):
    metrics = [(f, "x", f) for f in ("median", "std", "var", "nunique", "prod", "sem", "size")]
    got = {r.k: r for r in group(frame, ["k"], metrics).collect()}
    assert got["a"].median == 3.0 and got["a"].std == pytest.approx(statistics.stdev([2, 4]))
    assert got["a"].sem == pytest.approx(1.0) and got["b"].std is None and got["b"].size == 2
    assert got["a"]["prod"] == 8.0 and got["b"]["nunique"] == 1 and got["b"]["var"] is None
    with pytest.raises(ValueError):
        group(frame, ["k"], [("sideways", "x", "s")])


def test_default_names_and_missing_fields(frame):
    got = group(frame, ["k", "zzz"], [{"field": "x", "func": "max"}, {"field": "yyy", "func": "sum", "alias": "s"}], on_missing="pass")
    assert got.columns == ["k", "max_x"]
    with pytest.raises(ValueError):
        group(frame, ["zzz"], [("count", "*", "n")])
    assert group(frame) is frame


def test_first_last(spark):
    df = spark.createDataFrame([("a", 3, "z"), ("a", 1, None), ("a", 2, "y"), ("b", 1, None)], "k string, t long, v string")
    got = group(df, ["k"], [("first", "v", "f"), ("last", "v", "l"), ("first", "t", "ft")], order_by=["t"])
    assert rows(got) == [("a", "y", "z", 1), ("b", None, None, 1)]
    got = group(df, ["k"], [("first", "v", "f"), ("last", "v", "l")], order_by=[("t", False)])
    assert rows(got) == [("a", "z", "y"), ("b", None, None)]
    with pytest.raises(ValueError):
        group(df, ["k"], [("first", "v", "f")])


def test_having(frame):
    def keys(*having, **more):
        return [r.k for r in group(frame, ["k"], [("sum", "n", "s")], having, sort_keys=True, **more).collect()]

    def h(name, op, value):
        return {"metricAlias": name, "operator": op, "value": value}

    assert keys() == ["a", "b", "c"]
    assert keys(h("s", ">", "0")) == ["a", "c"] and keys(h("s", "!=", 7)) == ["a", "b"] and keys(h("s", "=", "7.0")) == ["c"]
    assert keys(h("s", ">=", "{least}"), variables={"least": 1}) == ["a", "c"]
    assert keys(h("k", "contains", "A")) == ["a"] and keys(h("k", "contains", "a,b")) == [] and keys(h("k", "!=", "a")) == ["b", "c"]
    assert keys(h("s", ">", 0), h("k", "=", "a")) == ["a"]


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_median_is_exact(spark, monkeypatch, threshold):
    monkeypatch.setattr(skew, "ROWS_PER_SHARD", 200)
    rng = random.Random(9)
    data = [(rng.choice(["hot", "hot", "hot", *"abcdefgh"]), rng.choice([None, rng.gauss(0, 1), float(rng.randint(0, 3))])) for _ in range(4000)]
    data += [("one", 4.0), ("two", 1.0), ("two", 2.0), ("same", 7.0)] + [("same", 7.0)] * 50 + [(None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(data, "k string, x double").repartition(9)
    values = {}
    for k, x in data:
        if x is not None:
            values.setdefault(k, []).append(x)
    want = {k: statistics.median(v) for k, v in values.items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for accuracy in (100_000, 50):
            got = {r.k: r.m for r in median(df, ["k"], "x", "m", null_keys=True, accuracy=accuracy).collect()}
            assert got == want
        whole = median(df, [], "x", "m").first().m
        assert whole == statistics.median([x for _, x in data if x is not None])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert median(df.where("false"), [], "x", "m").first().m is None


def test_overlap(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (None, None)], "a long, b string")
    b = spark.createDataFrame([(2, "y"), (None, None), (9, "z")], "other long, names string")
    c = spark.createDataFrame([(2.0, "y")], "a double, b string")
    d = spark.createDataFrame([(1, "x"), (9, "z"), (9, "z")], "a long, b string")
    got = rows(overlap(spark, [("a", a), ("b", b), ("c", c), ("d", d)]))
    assert got == [("a", "b", 2), ("a", "c", 0), ("a", "d", 1), ("b", "c", 0), ("b", "d", 1), ("c", "d", 0)]
    assert overlap(spark, [("a", a)]).collect() == [] and overlap(spark, []).columns == ["branch_a", "branch_b", "shared_rows"]
    assert rows(overlap(spark, [("a", a), ("c", c)])) == [("a", "c", 0)]


def test_overlap_of_many_branches(spark):
    base = spark.range(200)
    branches = [(f"b{i}", base.where(F.col("id") % (i + 2) == 0)) for i in range(63)]
    got = {(r.branch_a, r.branch_b): r.shared_rows for r in overlap(spark, branches).collect()}
    assert len(got) == 63 * 62 // 2
    for i, j in ((0, 1), (0, 62), (60, 61), (10, 61)):
        assert got[(f"b{i}", f"b{j}")] == sum(n % (i + 2) == 0 and n % (j + 2) == 0 for n in range(200))
