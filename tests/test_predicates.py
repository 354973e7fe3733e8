"""Condition grid: each operator, value and field against a plain Python reading."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from frames import DEALS_SCHEMA, as_dicts, random_deals
from tributary import search, where
from tributary.functions.predicates import condition, group


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(random_deals(), DEALS_SCHEMA).cache()


ROWS = as_dicts(random_deals(), DEALS_SCHEMA)
COMPARE = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
}


def having(field, *values):
    return sum(r[field] in values for r in ROWS)


def counts(frame, conditions):
    tests = [F.count_if(condition(frame.schema, c)).alias(str(i)) for i, c in enumerate(conditions)]
    return list(frame.agg(*tests).first())


def expect(c):
    value, op, field = c["value"], c["operator"], c["field"]
    negated = op in ("!=", "not_contains", "not_in_list")
    base = {"!=": "=", "not_contains": "contains", "not_in_list": "in_list"}.get(op, op)
    numeric = c.get("dataType") == "number" or isinstance(value, (int, float))
    parts = value if isinstance(value, list) else [p.strip() for p in str(value).split(",")]

    def test(cell):
        if cell is None:
            return False
        if base in COMPARE:
            return COMPARE[base](cell, float(value)) if numeric else COMPARE[base](str(cell), str(value))
        if base == "contains":
            return any(p.lower() in str(cell).lower() for p in parts)
        if base == "in_list":
            return any(cell == float(p) for p in parts if p) if numeric else str(cell) in parts
        return str(cell).startswith(value) if base == "starts_with" else str(cell).endswith(value)

    return sum(test(r[field]) != negated for r in ROWS)


NUMERIC = [
    {"field": f, "operator": op, "value": cast(v), **kind}
    for f, op, v in itertools.product(["units", "price"], [">", ">=", "<", "<=", "=", "!="], [*range(0, 98, 7), 2.5, 48])
    for cast, kind in ((lambda v: v, {}), (str, {"dataType": "number"}))
]
TEXT = [
    {"field": f, "operator": op, "value": v}
    for f, op, v in itertools.product(
        ["good", "state", "note"],
        ["=", "!=", "contains", "not_contains", "starts_with", "ends_with"],
        ["tea", "T", "Soap", "o", "on hold", "s,h", "zzz", "q, EA,so,zz,x", "1,2,3,4", "!", "%", "_", ""],
    )
]
LISTS = [
    {"field": f, "operator": op, "value": v}
    for f, op, v in itertools.product(
        ["good", "state", "note"], ["in_list", "not_in_list"], ["tea,rice", " open , done", ["salt"], "", "x", ["on hold", "Soap"]]
    )
]
NUMBER_LISTS = [
    {"field": f, "operator": op, "value": v, "dataType": "number"}
    for f, op, v in itertools.product(["units", "price"], ["in_list", "not_in_list"], ["1,2,3", "0.5,1.5", "26", ["13", "4"], ""])
]


@pytest.mark.parametrize("cases", [NUMERIC, TEXT, LISTS, NUMBER_LISTS], ids=["numeric", "text", "lists", "number_lists"])
def test_grid(frame, cases):
    for start in range(0, len(cases), 60):
        chunk = cases[start : start + 60]
        assert [(c, n) for c, n in zip(chunk, counts(frame, chunk))] == [(c, expect(c)) for c in chunk]


def test_null_and_empty(frame):
    ops = ["is_null", "is_not_null", "is_empty", "is_not_empty"]
    got = counts(frame, [{"field": "note", "operator": op} for op in ops])
    nulls = sum(r["note"] is None for r in ROWS)
    empties = nulls + sum(r["note"] == "" for r in ROWS)
    assert got == [nulls, len(ROWS) - nulls, empties, len(ROWS) - empties]


def test_booleans(frame):
    cases = [
        {"field": "paid", "operator": "is_true"},
        {"field": "paid", "operator": "is_false"},
        {"field": "paid", "operator": "=", "value": "True"},
        {"field": "paid", "operator": "!=", "value": True},
        {"field": "paid", "operator": "in_list", "value": "true,false"},
    ]
    yes, no = sum(r["paid"] is True for r in ROWS), sum(r["paid"] is False for r in ROWS)
    assert counts(frame, cases) == [yes, no, yes, len(ROWS) - yes, yes + no]


def test_numbers_as_text(spark):
    df = spark.createDataFrame([("5",), ("5.0",), ("abc",), (None,)], "t string")
    cases = [
        {"field": "t", "operator": "=", "value": 5},
        {"field": "t", "operator": ">", "value": "4", "dataType": "number"},
        {"field": "t", "operator": "!=", "value": 5},
        {"field": "t", "operator": "=", "value": "5"},
    ]
    assert counts(df, cases) == [2, 2, 2, 1]


def test_number_column_with_text_value(frame):
    cases = [
        {"field": "units", "operator": "=", "value": "26"},
        {"field": "units", "operator": "=", "value": "26.0"},
        {"field": "units", "operator": "!=", "value": "many"},
        {"field": "price", "operator": "starts_with", "value": "1."},
        {"field": "units", "operator": "contains", "value": "26"},
    ]
    is26 = sum(r["units"] == 26 for r in ROWS)
    ones = sum(r["price"] is not None and str(r["price"]).startswith("1.") for r in ROWS)
    assert counts(frame, cases) == [is26, is26, len(ROWS), ones, sum("26" in str(r["units"]) for r in ROWS)]


def test_bad_values_fail_when_built(frame):
    for bad in (
        {"field": "units", "operator": ">", "value": "many"},
        {"field": "nothing", "operator": "=", "value": 1},
        {"field": "units", "operator": "resembles", "value": 1},
        {"field": "units", "operator": "=", "value": "{gone}", "valueType": "variable"},
        {"field": "units", "operator": "in_variable", "value": "gone"},
    ):
        with pytest.raises(ValueError):
            condition(frame.schema, bad)


def test_pass_on_missing(frame):
    cases = [
        {"field": "nothing", "operator": "=", "value": 1},
        {"field": "units", "operator": "resembles", "value": 1},
        {"field": "units", "operator": "in_variable", "value": "gone"},
        {"field": "units", "operator": "not_in_variable", "value": "gone"},
        {"field": "units", "operator": "!=", "value": "", "dataType": "number"},
    ]
    tests = [F.count_if(condition(frame.schema, c, on_missing="pass")) for c in cases]
    assert list(frame.agg(*tests).first()) == [len(ROWS), len(ROWS), 0, len(ROWS), len(ROWS)]


def test_dates(spark):
    rows = [(dt.datetime(2024, 3, d, h), dt.date(2024, 3, d), f"2024-03-{d:02d}") for d in (1, 2, 3) for h in (0, 12)]
    df = spark.createDataFrame([*rows, (None, None, None)], "at timestamp, day date, text string")
    for field in ("at", "day", "text"):
        kind = {"dataType": "date"}
        cases = [
            {"field": field, "operator": "=", "value": "2024-03-02", **kind},
            {"field": field, "operator": "!=", "value": "2024-03-02", **kind},
            {"field": field, "operator": "before", "value": "2024-03-02", **kind},
            {"field": field, "operator": "after", "value": "2024-03-02", **kind},
            {"field": field, "operator": "<=", "value": "2024-03-02", **kind},
        ]
        assert counts(df, cases) == [2, 5, 2, 3 if field == "at" else 2, 3 if field == "at" else 4]
    exact = {"field": "at", "operator": "=", "value": "2024-03-02 12:00:00"}
    some = {"field": "at", "operator": "in_list", "value": "2024-03-01,2024-03-03"}
    assert counts(df, [exact, some]) == [1, 4]


def test_json_keys(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('{\"a\": 1}', named_struct('a', 1, 'b', 'X'), map('a', 1)),"
        " ('{\"b\": null}', named_struct('a', 2, 'b', 'y'), map('b', 2)), ('broken', NULL, NULL) AS t(j, s, m)"
    )
    cases = [
        {"field": "j", "operator": "has_key", "value": "a"},
        {"field": "j", "operator": "has_key", "value": "b"},
        {"field": "s", "operator": "has_key", "value": "b"},
        {"field": "s", "operator": "has_key", "value": "c"},
        {"field": "m", "operator": "has_key", "value": "a"},
        {"field": "s", "operator": "contains", "value": "x"},
    ]
    assert counts(df, cases) == [1, 1, 2, 0, 1, 1]


def test_groups_and_words(frame):
    a = {"field": "units", "operator": ">", "value": 50}
    b = {"field": "good", "operator": "=", "value": "tea"}
    trees = [
        {"conditions": []},
        {"logicalOperator": "AND", "conditions": [a, b]},
        {"logicalOperator": "OR", "conditions": [a, b]},
        {"logicalOperator": "XOR", "conditions": [a, b]},
        {"logicalOperator": "AND", "conditions": [a, {"type": "group", "logicalOperator": "OR", "conditions": [b, {"type": "group", "conditions": []}]}]},
    ]
    both = sum(r["units"] > 50 and r["good"] == "tea" for r in ROWS)
    one = sum(r["units"] > 50 or r["good"] == "tea" for r in ROWS)
    got = list(frame.agg(*[F.count_if(group(frame.schema, t)) for t in trees]).first())
    assert got == [len(ROWS), both, one, one, sum(r["units"] > 50 for r in ROWS)]


def test_search(frame):
    def found(*args, **options):
        return frame.where(search(frame.schema, *args, **options)).count()

    assert found("TEA") == sum(any("tea" in str(v).lower() for v in r.values() if v is not None) for r in ROWS)
    assert found("TEA", case_sensitive=True) == 0
    assert found("tea", "good", "equals") == having("good", "tea")
    assert found("so", "good", "starts") == having("good", "Soap") and found("so", "good", "starts", case_sensitive=True) == 0
    assert found("DONE", mode="ends") == sum(any(str(v).lower().endswith("done") for v in r.values() if v is not None) for r in ROWS)
    assert found("  ") == len(ROWS)
    with pytest.raises(ValueError):
        found("x", mode="sounds")


VARIABLES = {"ids": ["1", "2", None], "goods": "tea, salt", "floor": 90}


def test_list_variables(frame):
    def n(field, operator, value, **more):
        return where(frame, {"field": field, "operator": operator, "value": value, **more}, VARIABLES).count()

    assert n("id", "in_variable", "ids") == 2
    assert n("id", "not_in_variable", "{ids}") == len(ROWS) - 2
    assert n("good", "in_variable", "goods") == having("good", "tea", "salt")
    assert n("good", "in_list", "{goods}") == having("good", "tea", "salt")
    assert n("good", "not_in_list", "goods", valueType="variable") == len(ROWS) - having("good", "tea", "salt")
    assert n("good", "contains", "{goods}") == having("good", "tea", "salt")
    assert n("units", ">", "{floor}") == sum(r["units"] > 90 for r in ROWS)
    assert n("good", "=", "{not a variable}") == 0
    nulls = sum(r["note"] is None for r in ROWS)
    assert n("note", "in_variable", "ids") == nulls and n("note", "not_in_variable", "ids") == len(ROWS) - nulls


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_captured_columns(spark, frame, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        notes = [r["note"] for r in ROWS if r["id"] % 3 == 0 and r["id"] > 30] + ["no such note"]
        captured = {
            "notes": spark.createDataFrame([(v,) for v in notes], "v string"),
            "texts": spark.createDataFrame([("3",), ("7",), ("x",)], "v string"),
            "ends": spark.createDataFrame([("!",), ("EA-5",), (None,)], "v string"),
        }
        inside = {r["id"] for r in ROWS if r["note"] in notes}
        everyone = {r["id"] for r in ROWS}

        def ids(tree):
            return {r.id for r in where(frame, tree, captured).select("id").collect()}

        def leaf(field, op, value):
            return {"field": field, "operator": op, "value": value}

        assert ids(leaf("note", "in_variable", "notes")) == inside
        assert ids(leaf("note", "not_in_variable", "{notes}")) == everyone - inside
        low = {r["id"] for r in ROWS if r["units"] < 20}
        tree = {"logicalOperator": "OR", "conditions": [leaf("units", "<", 20), leaf("note", "in_variable", "notes")]}
        assert ids(tree) == inside | low
        tree = {"logicalOperator": "OR", "conditions": [leaf("units", "<", 20), leaf("note", "not_in_variable", "notes")]}
        assert ids(tree) == (everyone - inside) | low
        assert ids(leaf("id", "in_list", "{texts}")) == {3, 7}
        assert ids(leaf("note", "ends_with", "{ends}")) == {r["id"] for r in ROWS if (r["note"] or "").endswith("!")}
        some = {r["id"] for r in ROWS if r["note"] and ("!" in r["note"] or "ea-5" in r["note"].lower())}
        assert ids(leaf("note", "contains", "{ends}")) == some
        assert ids(leaf("note", "not_contains", "{ends}")) == everyone - some
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    tree = {
        "logicalOperator": "AND",
        "conditions": [
            {"field": "o_custkey", "operator": ">", "value": "10", "dataType": "number"},
            {"field": "o_orderstatus", "operator": "!=", "value": "F"},
            {"field": "o_orderdate", "operator": "=", "value": "1996-01-02"},
        ],
    }
    plan = where(df, tree).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1]
    assert "GreaterThan(o_custkey,10)" in pushed and "o_orderdate" in pushed and "Or(IsNull(o_orderstatus" in pushed
