"""Expression text against Python's own evaluation."""

import math
import subprocess
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tributary import UserFunction, transform
from tributary.functions.expressions import NotPython, UnknownName, python_expression

ROWS = [
    (1, 7, 2.5, "ab", True), (2, -7, -0.5, "b", False), (3, 0, 0.0, "", True),
    (4, 12, 3.0, "abc", False), (5, -1, 1e6, "Z z", True), (6, 3, -2.0, "a", True),
]
SCHEMA = "i long, n int, x double, s string, b boolean"
NAMES = ["i", "n", "x", "s", "b"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1).cache()


def by_python(text):
    out = []
    for row in ROWS:
        try:
            value = eval(text, {"__builtins__": {"int": int, "float": float, "str": str}}, dict(zip(NAMES, row)))
            out.append(None if isinstance(value, complex) else value)
        except (ArithmeticError, TypeError, ValueError):
            out.append(None)
    return out


def same(a, b):
    if a is None or b is None or isinstance(a, str) or isinstance(b, str):
        return a == b
    return math.isclose(float(a), float(b), rel_tol=1e-12, abs_tol=1e-12)


def check(frame, texts):
    made = transform(frame, [{"outputField": f"o{k}", "expression": t} for k, t in enumerate(texts)])
    got = sorted(made.collect())
    for k, text in enumerate(texts):
        want = by_python(text)
        mine = [r[f"o{k}"] for r in got]
        assert all(map(same, mine, want)), (text, mine, want)


FIXED = [
    "n + 1", "i * 2", "n + x", "i - x", "i / 2", "n / i", "i / n", "n // 2", "n // -2", "i // n", "x // 2",
    "n % 3", "n % -3", "i % n", "x % 0.7", "-n % 5", "n ** 2", "x ** 2", "x ** 0.5", "n ** -1", "(n + 1) * (i - 2)", "-x", "+n",
    "n > 0", "0 < n <= 7", "s == 'ab'", "n == x", "s == n", "s != n", "not b", "b and n > 0", "b or n < 0", "n > 0 and x > 0 or b",
    "'up' if n > 0 else 'down'", "n if b else x", "s + '!'", "s + s", "s * 2", "2 * s", "s + n", "s > n", "'a' in s", "'a' not in s",
    "n in (7, 3)", "s in ['b', 'a']", "int(x)", "float(n)", "str(i)", "n & 6", "n | 1", "n ^ 5", "True", "1", "2.5 * 2", "b + 1",
    "1 if s else 0", "n or i", "n and i", "n * 4611686018427387904 * 0 == 0 if n == 0 else 1",
]


def test_fixed_expressions(frame):
    check(frame, FIXED)


numbers = st.one_of(st.sampled_from(["i", "n", "x"]), st.integers(-9, 9).map(str), st.sampled_from(["0.5", "2.25", "-1.5"]))
arithmetic = st.recursive(
    numbers,
    lambda inner: st.one_of(
        st.tuples(inner, st.sampled_from(["+", "-", "*", "/", "//", "%"]), inner).map(lambda t: f"({t[0]} {t[1]} {t[2]})"),
        st.tuples(inner, st.sampled_from(["<", ">=", "=="]), inner, inner, inner).map(
            lambda t: f"({t[3]} if {t[0]} {t[1]} {t[2]} else {t[4]})"
        ),
    ),
    max_leaves=5,
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(arithmetic, min_size=20, max_size=20))
def test_random_arithmetic(frame, texts):
    made = transform(frame, [{"outputField": f"o{k}", "expression": t} for k, t in enumerate(texts)])
    got = sorted(made.collect())
    for k, text in enumerate(texts):
        for mine, want, row in zip([r[f"o{k}"] for r in got], by_python(text), ROWS):
            if want is not None and mine is not None and isinstance(want, (int, float)):
                assert math.isclose(float(mine), float(want), rel_tol=1e-6, abs_tol=1e-6), (text, row, mine, want)
            elif want is not None and mine is None:
                # Null spreads: a part Python never looked at, or a comparison with a failed part.
                assert "/" in text or "%" in text, (text, row, want)
            else:
                assert want is None or mine == want, (text, row, mine, want)


def test_overflow_and_null_are_null(spark):
    df = spark.createDataFrame([(2**62, None), (1, 3)], "a long, b long")
    made = transform(df, [{"outputField": "o", "expression": "a * 4"}, {"outputField": "p", "expression": "b + 1"}])
    assert [(r.o, r.p) for r in made.collect()] == [(None, None), (4, 4)]


def test_siblings_do_not_see_each_other(frame):
    with pytest.raises(UnknownName):
        transform(frame, [{"outputField": "y", "expression": "n + 1"}, {"outputField": "z", "expression": "y + 1"}])
    replaced = transform(frame, [{"outputField": "n", "expression": "n + 1"}, {"outputField": "m", "expression": "n * 2"}])
    assert replaced.columns == ["i", "n", "x", "s", "b", "m"]
    assert [(r.n, r.m) for r in replaced.where("i = 1").collect()] == [(8, 14)]


def test_sql_text_and_variables(frame):
    variables = {"k": 10, "quote": "it's", "some": [1, 4], "none": []}
    mappings = [
        {"outputField": "a", "expression": "n + {k}"},
        {"outputField": "b2", "expression": "s || {quote}"},
        {"outputField": "c", "expression": "CASE WHEN i IN {some} THEN 'y' ELSE '{other}' END"},
        {"outputField": "d", "expression": "i in {some}"},
        {"outputField": "e", "expression": "abs(n) + {k}"},
        {"outputField": "f", "expression": "", "mode": "simple"},
    ]
    row = transform(frame, mappings, variables).where("i = 4").first()
    assert (row.a, row.b2, row.c, row.d, row.e) == (22, "abcit's", "y", True, 22)
    assert not [c for c in transform(frame, mappings, variables).columns if c.startswith("__")]
    assert transform(frame, mappings, variables).where("i = 2").first().c == "{other}"


def test_not_python(frame):
    for text in ("a ||| b", "len(s)", "s[0]", "s.upper()", "lambda: 1", "[i for i in s]"):
        with pytest.raises(NotPython):
            python_expression(text, frame.schema)


def test_user_functions(frame):
    def risky(row):
        return 10 / row["n"]

    def first_letter(row):
        return row["s"][0]

    def double(batch):
        return batch["x"] * 2

    functions = {"inverse": UserFunction(risky, "double", ["n"]), "letter": UserFunction(first_letter, "string")}
    mappings = [
        {"outputField": "inverse", "expression": "def transform(row): ...", "mode": "python"},
        {"outputField": "first", "expression": "letter", "mode": "python"},
        {"outputField": "twice", "expression": UserFunction(double, "double", ["x"], batch=True)},
    ]
    got = {r.i: (r.inverse, r["first"], r.twice) for r in transform(frame, mappings, functions=functions).collect()}
    assert got[3] == (None, None, 0.0) and got[4] == (10 / 12, "a", 6.0)
    with pytest.raises(ValueError):
        transform(frame, [{"outputField": "z", "expression": "def transform(row): return 1", "mode": "python"}])


def test_functions_run_where_the_package_is_not_installed(tmp_path):
    """Workers of a session started elsewhere cannot import the package."""
    root = __file__.rsplit("/tests/", 1)[0]
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from tributary.examples import QUERIES
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("udf_row", "udf_vector"):
    QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
print("done")
"""
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "done" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("exponent", [2, 3, 5, 6, 31, 62, 63, 64])
def test_whole_powers_to_the_edge_of_a_long(spark, exponent):
    """Exact up to the last number whose power is a long; what is beyond is told by its size and never multiplied."""
    roots = [round((2**63) ** (1 / exponent)) + d for d in range(-3, 4)]
    values = sorted({0, 1, 2, 2**62, 2**63 - 1, *roots})
    values = [None, *values, *[-v for v in values], -(2**63)]
    df = transform(spark.createDataFrame([(v,) for v in values], "n long"), [{"outputField": "p", "expression": f"n ** {exponent}"}])
    want = [None if v is None or not -(2**63) <= v**exponent < 2**63 else v**exponent for v in values]
    assert [r.p for r in df.collect()] == want
    fitting = [v for v in range(3 + max(w for w in roots)) if v**exponent < 2**63] if exponent > 5 else None
    if fitting:
        assert f"<= {fitting[-1]})" in df._jdf.queryExecution().optimizedPlan().toString()
