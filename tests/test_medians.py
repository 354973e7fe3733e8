"""Medians of several fields and types at once, with cells that are crowded, empty and infinite."""

import decimal
import random
import statistics

import pytest

from tributary import group


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_fields_of_several_types_share_a_pass(spark, keys):
    rng = random.Random(7)
    rows = []
    for i in range(700):
        x = rng.choice([None, float("nan"), rng.gauss(0, 1), 1e308, -1e308, 5.0, float("inf")])
        rows.append((i % 3 if i % 7 else None, x, rng.choice([rng.random() * 1e-9, 3.0, 4.0]), rng.choice([2**60 + i, i, None]), rng.choice([decimal.Decimal(i) / 8, None])))
    df = spark.createDataFrame(rows, "k long, x double, y double, n long, d decimal(12,3)").repartition(5)
    metrics = [("median", c, f"m_{c}") for c in "xynd"] + [("count", "*", "rows"), ("sum", "y", "total"), ("median", "y", "again")]
    got = {r[0] if keys else None: r for r in group(df, keys, metrics).collect()}
    for k in {r[0] for r in rows if r[0] is not None} if keys else [None]:
        own = [r for r in rows if not keys or r[0] == k]
        for at, c in enumerate("xynd", 1):
            values = [r[at] for r in own if r[at] is not None and r[at] == r[at]]
            low, high = statistics.median_low(values), statistics.median_high(values)
            want = float((low + high) / 2) if c == "d" else float(low) / 2 + float(high) / 2
            assert got[k][f"m_{c}"] == want
        assert got[k]["again"] == got[k]["m_y"] and got[k]["rows"] == len(own)
    assert len(got) == (3 if keys else 1)


def test_no_task_ranks_everything(spark):
    plan = group(spark.range(100).selectExpr("id * 1.5D AS x"), [], [("median", "x", "m")])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in "".join(line for line in plan.splitlines() if "Window" in line)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k long, x double")
    assert group(empty, ["k"], [("median", "x", "m")]).count() == 0
    assert [tuple(r) for r in group(empty, [], [("median", "x", "m"), ("count", "*", "n")]).collect()] == [(None, 0)]
