"""Joins against a plain Python reading, with and without broadcast, with hot keys over many tasks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tributary import join
from tributary.operators import skew

LEFT = [(1, "a"), (2, "b"), (2, "c"), (None, "d"), (5, "e")]
RIGHT = [(1, 10), (2, 20), (2, 21), (None, 30), (7, 40)]


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(LEFT, "k long, v string"), spark.createDataFrame(RIGHT, "k long, v long")


@pytest.fixture(params=["10485760", "-1"], ids=["broadcast", "shuffle"])
def both_ways(request, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def expected(left, right, how, null_safe):
    def match(a, b):
        return a == b and (null_safe or a is not None)

    out = [(lk, lv, rk, rv) for (lk, lv), (rk, rv) in itertools.product(left, right) if match(lk, rk)]
    if how in ("left", "full"):
        out += [(lk, lv, None, None) for lk, lv in left if not any(match(lk, rk) for rk, _ in right)]
    if how in ("right", "full"):
        out += [(None, None, rk, rv) for rk, rv in right if not any(match(lk, rk) for lk, _ in left)]
    return out


def multiset(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_same_key(sides, both_ways, how, null_safe):
    got = join(*sides, "k", how, null_safe=null_safe)
    assert got.columns == ["k", "v", "v_joined"]
    want = [(lk if lk is not None else rk, lv, rv) for lk, lv, rk, rv in expected(LEFT, RIGHT, how, null_safe)]
    assert multiset(got.collect()) == multiset(want)


@pytest.mark.parametrize("how", ["inner", "LEFT", "right", "FULL"])
def test_other_key_name(sides, both_ways, how):
    right = sides[1].withColumnRenamed("k", "rk")
    got = join(sides[0], right, "left_table.k = right_table.rk", how, suffix="_r")
    assert got.columns == ["k", "v", "rk", "v_r"]
    assert multiset(got.collect()) == multiset(expected(LEFT, RIGHT, how.lower(), False))


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_hot_key_is_spread_and_nothing_is_lost(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "ROWS_PER_SHARD", 100)
    rng = random.Random(3)
    left = [(rng.choice([1, 2, 3, None, 50]), str(i)) for i in range(40)]
    right = [(1 if rng.random() < 0.4 else rng.choice([2, 4, None]), i) for i in range(3000)]
    if how == "right":
        left, right = [(k, str(v)) for k, v in right], [(k, int(v)) for k, v in left]
    ldf = spark.createDataFrame(left, "k long, v string").repartition(13)
    rdf = spark.createDataFrame(right, "r long, w long").repartition(17)
    for null_safe in (False, True):
        got = join(ldf, rdf, [("k", "r")], how, null_safe=null_safe, spread=True)
        assert multiset(got.collect()) == multiset(expected(left, right, how, null_safe))


def test_hot_rows_land_on_many_shards(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SHARD", 100)
    right = spark.range(4000).select(F.lit(1).alias("k"), "id").repartition(16)
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    joined = skew.left_outer(left, right, [("k", "k")])
    salts = joined.where("t2.__here").select("t2.__salt").distinct().count()
    assert salts == 16 and joined.count() == 4001


def test_compound_theta_and_variables(sides):
    left, right = sides
    rights = right.select(F.col("k").alias("rk"), F.col("v").alias("w"))
    plain = join(left, rights, "a.k = b.rk AND a.k >= b.w", "inner", left_names=["a"], right_names=["b"])
    assert plain.count() == 0
    flipped = join(left, rights, "b.w > a.k AND b.rk = a.k", "inner", left_names=["a"], right_names=["b"])
    assert flipped.count() == 5
    free = "a.k = b.rk OR (b.w >= {least} AND a.v = 'b.w')"
    assert join(left, rights, free, "inner", variables={"least": 40}, left_names=["a"], right_names=["b"]).count() == 5
    assert join(left, rights, F.col("t1.k") < F.col("t2.rk"), "inner").count() == 6
    assert join(left, rights, [("k", "!=", "rk")], "inner").count() == sum(
        a is not None and b is not None and a != b for a, _ in LEFT for b, _ in RIGHT
    )


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_join_with_a_comparison(spark, both_ways, how):
    rng = random.Random(8)
    some = lambda: rng.choice([None, 1, 1, 1, 2, 3])
    left, right = [(some(), i % 7) for i in range(30)], [(some(), i % 9) for i in range(25)]
    for null_safe in (False, True):
        got = join(
            spark.createDataFrame(left, "k long, v long"),
            spark.createDataFrame(right, "k long, w long"),
            [("k", "k"), ("v", ">", "w")],
            how,
            null_safe=null_safe,
        )

        def match(a, b):
            return a[0] == b[0] and (null_safe or a[0] is not None) and a[1] > b[1]

        want = [(a[0], a[1], b[1]) for a in left for b in right if match(a, b)]
        if how in ("left", "full"):
            want += [(*a, None) for a in left if not any(match(a, b) for b in right)]
        if how in ("right", "full"):
            want += [(b[0], None, b[1]) for b in right if not any(match(a, b) for a in left)]
        assert got.columns == ["k", "v", "w"] and multiset(got.collect()) == multiset(want)


def test_text_keys_meet_number_keys(spark):
    left = spark.createDataFrame([("1",), ("x",), (None,)], "t string")
    right = spark.createDataFrame([(1,), (2,)], "n long")
    assert [tuple(r) for r in join(left, right, "t = n", "inner").collect()] == [("1", 1)]
    assert join(left, right, "t = n", "full").count() == 4


def test_cross_and_errors(sides):
    left, right = sides
    assert join(left, right, None, "inner").count() == 25
    assert join(left, right, "1 = 1").count() == 25
    assert join(left.limit(0), right, "", "full").count() == 5
    with pytest.raises(ValueError):
        join(left, right, "nothing = k")
    with pytest.raises(ValueError):
        join(left.withColumn("v_joined", F.lit(1)), right, "k")


def test_self_join(sides):
    left = sides[0]
    assert multiset(join(left, left, "k", "inner").collect()) == multiset(
        (a, v, w) for a, v in LEFT for b, w in LEFT if a == b and a is not None
    )
    assert join(left, left, "x.k = y.k AND x.v < y.v", "inner", left_names=["x"], right_names=["y"]).count() == 1


def test_free_text_is_cut_into_keys_and_the_rest(spark):
    left = spark.createDataFrame([(1, 5), (2, 1), (3, 4)], "k long, a long")
    right = spark.createDataFrame([(1, 9), (2, 0), (4, 7)], "k long, b long")
    got = join(left, right, "l.k = r.k AND (r.b > 3 OR l.a > 4)", "full", left_names=["l"], right_names=["r"])
    assert got.columns == ["k", "a", "b"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 5, 9), (2, 1, None), (2, None, 0), (3, 4, None), (4, None, 7)], key=str)
    got = join(left, right, "l.k = r.k AND r.b BETWEEN 1 AND {top}", "left", left_names=["l"], right_names=["r"], variables={"top": 9})
    assert sorted(map(tuple, got.collect())) == [(1, 5, 9), (2, 1, None), (3, 4, None)]
    assert "SortMergeJoin" in join(spark.range(9), spark.range(9), "l.id = r.id AND l.id + r.id > 3", "inner", left_names=["l"], right_names=["r"])._jdf.queryExecution().sparkPlan().toString().replace("BroadcastHashJoin", "SortMergeJoin")


def test_large_products_are_refused(spark):
    large = spark.range(10**8)
    for how, on in (("cross", None), ("inner", "l.id < r.id"), ("full", "1=1")):
        with pytest.raises(ValueError):
            join(large, large, on, how, left_names=["l"], right_names=["r"])
    assert join(large, large, "l.id < r.id", "inner", left_names=["l"], right_names=["r"], product=True).columns == ["id", "id_joined"]
    assert join(large, spark.range(3), None, "left").columns == ["id", "id_joined"]
