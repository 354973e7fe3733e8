"""Sources, sinks, typed columns, workspace, raw SQL, views and pages."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tributary import (
    Workspace,
    cast_fields,
    clean_nonfinite,
    page,
    read_csv,
    read_table,
    sort,
    view,
    write_csv,
)
from tributary.functions.casts import spark_pattern
from tributary.functions.names import table_name

CSV = """ order id ,amount,when,paid,note,code
1,10.5,2024-01-05,True,"a ""quoted"" word, with comma",007
2,NA,2024-02-30,false,,1e3
3,-4,,FALSE,null,12
"""


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "small orders.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_types_and_names(spark, csv_file):
    df = read_csv(spark, csv_file)
    assert dict(df.dtypes) == {"order_id": "bigint", "amount": "double", "when": "string", "paid": "boolean", "note": "string", "code": "double"}
    rows = [tuple(r) for r in df.orderBy("order_id").collect()]
    assert rows[0] == (1, 10.5, "2024-01-05", True, 'a "quoted" word, with comma', 7.0)
    assert rows[1] == (2, None, "2024-02-30", False, None, 1000.0)
    assert rows[2][2] is None and rows[2][4] is None


def test_csv_schema_and_tokens(spark, csv_file):
    df = read_csv(spark, csv_file, schema="order_id int, code string, note string", null_tokens=[""])
    assert df.dtypes == [("order_id", "int"), ("code", "string"), ("note", "string")]
    assert [r.note for r in df.orderBy("order_id").collect()][1:] == [None, "null"]


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('a,b\n1,"two\nlines"\n')
    assert [tuple(r) for r in read_csv(spark, str(path), multiline=True).collect()] == [(1, "two\nlines")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you', 0.1), (2, None, None)], "a long, b string, c double")
    out = str(tmp_path / "out")
    write_csv(df, out)
    assert sorted(map(tuple, read_csv(spark, out).collect())) == sorted(map(tuple, df.collect()))


def test_unsupported_file(spark):
    with pytest.raises(ValueError):
        read_table(spark, "/tmp/sheet.xlsx")


def test_table_names():
    assert table_name("big orders.csv") == "big orders" and table_name("a.b.parquet") == "a.b" and table_name("x-y") == "x-y"
    for word in ("select", "Table.csv", "VIEW"):
        with pytest.raises(ValueError):
            table_name(word)


def test_cast_formats(spark):
    rows = [("2024-03-01", "01/03/2024", "2024/03/01 10:20:30", "1709288430000", "12", "yes", "3.5"), ("2024-13-01", "31/02/2024", "x", "x", "x", "x", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string")
    got = cast_fields(
        df,
        {
            "a": {"type": "date", "format": "YYYY-MM-DD"},
            "b": {"type": "date", "format": "DD/MM/YYYY"},
            "c": {"type": "timestamp", "format": "YYYY/MM/DD HH:mm:ss"},
            "d": {"type": "timestamp", "format": "Timestamp (ms)"},
            "e": "number",
            "f": "boolean",
            "g": "json",
        },
    )
    assert [t for _, t in got.dtypes] == ["date", "date", "timestamp", "timestamp", "double", "boolean", "string"]
    good, bad = got.select(*[F.col(c).cast("string") for c in got.columns]).collect()
    assert tuple(good) == ("2024-03-01", "2024-03-01", "2024-03-01 10:20:30", "2024-03-01 10:20:30", "12.0", "true", "3.5")
    assert tuple(bad) == (None,) * 7
    iso = spark.createDataFrame([("2024-03-01T10:20:30Z",)], "t string")
    assert cast_fields(iso, {"t": {"type": "timestamp", "format": "ISO8601"}}).first().t is not None
    assert spark_pattern("DD.MM.YY hh:mm A") == "dd.MM.yy hh:mm a"
    with pytest.raises(ValueError):
        cast_fields(df, {"zzz": "number"})
    with pytest.raises(ValueError):
        cast_fields(df, {"a": "colour"})


def test_clean_nonfinite(spark):
    df = spark.createDataFrame([(1.0, 1), (math.nan, 2), (math.inf, 3), (-math.inf, 4), (None, 5)], "x double, n int")
    assert [r.x for r in clean_nonfinite(df).orderBy("n").collect()] == [1.0, None, None, None, None]


def test_workspace(spark, csv_file):
    ws = Workspace(spark)
    assert ws.inventory().collect() == []
    assert ws.ingest(csv_file) == "small orders" and ws.ingest(csv_file, "order-items") == "order-items"
    assert "order-items" in ws and ws.table("small orders").count() == 3
    log = [tuple(r) for r in ws.ingest_log().select("file_name", "dataset_name", "table_name", "rows").orderBy("dataset_name").collect()]
    assert log == [("small orders.csv", "order-items", "order-items", 3), ("small orders.csv", "small orders.csv", "small orders", 3)]
    assert sorted(map(tuple, ws.inventory().collect())) == [("order-items", 3, 6), ("small orders", 3, 6)]
    old = ws.table("order-items")
    ws.save("order-items", old.where("amount > 0"))
    assert ws.table("order-items").count() == 1 and old.count() == 3
    assert ws.sql("SELECT count(*) AS n FROM `order-items`").first().n == 1
    assert ws.preview("small orders", 2).count() == 2
    assert ws.drop("order-items") and "order-items" not in ws
    with pytest.raises(ValueError):
        ws.table("order-items")


SOUND_SQL = [
    "SELECT a . id , count ( * ) AS n FROM stock AS a JOIN stock AS b ON a . id = b . id WHERE a . id BETWEEN 1 AND 3 GROUP BY a . id",
    "SELECT max ( id ) OVER ( PARTITION BY id % 2 ) AS top FROM stock WHERE NOT id IN ( 2 , 3 )",
    "SELECT CASE WHEN id > 2 THEN 'more' ELSE 'less' END AS word FROM stock",
]


def damaged():
    """Sound statements with one token missing that the grammar can't do without, or with one twice in a row."""
    for text in SOUND_SQL:
        tokens = text.split()
        for i, token in enumerate(tokens):
            if token in ("(", ")", "AND", "THEN", "END", "BETWEEN", "IN"):
                yield " ".join(tokens[:i] + tokens[i + 1 :])
            if token in ("FROM", "WHERE", "GROUP", "ON", "BETWEEN", "THEN", ",", "AS", "IN"):
                yield " ".join(tokens[: i + 1] + tokens[i:])


@pytest.fixture(scope="module")
def stock(spark):
    ws = Workspace(spark)
    ws.attach("stock", spark.range(5))
    return ws


@pytest.mark.parametrize("text", SOUND_SQL)
def test_sound_sql_runs(stock, text):
    assert stock.sql(text).collect()


@pytest.mark.parametrize("text", sorted(set(damaged())))
def test_damaged_sql_is_refused(stock, text):
    with pytest.raises(Exception):
        stock.sql(text).collect()
    assert stock.sql("SELECT * FROM stock").count() == 5


@pytest.mark.parametrize("text", ["DROP VIEW stock", "SELECT 1) ; DROP VIEW stock ; SELECT (1", "INSERT INTO stock SELECT 9", "SELECT id FROM missing", "SELECT missing FROM stock", "SELECT * FROM stock WHERE", ""])
def test_sql_that_is_no_query_of_known_tables_is_refused(stock, text):
    with pytest.raises(Exception):
        stock.sql(text).collect()
    assert stock.sql("SELECT * FROM stock").count() == 5


def test_sql_pages(spark):
    ws = Workspace(spark)
    ws.attach("deals", spark.range(23))
    pages = [[r.id for r in ws.sql_page("SELECT id FROM deals -- all", n, 10, ["id"]).collect()] for n in (1, 2, 3, 4)]
    assert pages == [list(range(10)), list(range(10, 20)), [20, 21, 22], []]
    assert ws.sql("WITH t AS (SELECT id FROM deals ORDER BY id DESC) SELECT * FROM t LIMIT 2;").count() == 2
    assert ws.sql("SELECT id FROM deals WHERE id > :least", {"least": 20}).count() == 2
    with pytest.raises(ValueError):
        page(ws.table("deals"), 0, 10, ["id"])


def test_views(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", 5), (2, "a", 7), (None, "c", 1)], "n long, s string, v long")
    assert view(df, ["s", "n", "s"]).columns == ["s", "n"]
    assert view(df, ["s", {"field": "n", "distinct": True}, {"field": "n", "distinct": True}]).count() == 3
    assert [r.n for r in view(df, [], [("n", True)]).collect()] == [1, 2, 2, None]
    assert [r.n for r in view(df, [], [{"field": "n", "ascending": False}, {"field": "v"}, ("n", True)]).collect()] == [2, 2, 1, None]
    assert [r.s for r in view(df, ["s"], [("n", False), ("s", True)], 2).collect()] == ["a", "a"]
    assert view(df, limit=0).count() == 0 and view(df, limit=-1).count() == 4 and view(df).count() == 4
    assert view(df, ["zzz"], on_missing="pass").columns == ["n", "s", "v"]
    assert sort(df, "zzz", on_missing="pass").count() == 4 and sort(df, None).count() == 4
    assert [r.v for r in sort(df, "v").collect()] == [1, 5, 7, None]
    for call in (lambda: view(df, ["zzz"]), lambda: sort(df, "zzz")):
        with pytest.raises(ValueError):
            call()


def test_topk_is_one_operator(spark):
    plan = view(spark.range(100), sorts=[("id", False)], limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_a_workspace_lasts(spark, tmp_path):
    root = f"file://{tmp_path}/tables"
    first = Workspace(spark, root)
    for n in range(4):
        first.save("numbers", spark.range(n))
    first.save("gone", spark.range(9))
    assert first.drop("gone") and not first.drop("gone")
    again = Workspace(spark, root)
    assert again.names() == ["numbers"] and again.table("numbers").count() == 3
    assert again.sql("SELECT * FROM numbers").count() == 3
    assert len(list((tmp_path / "tables" / "numbers").iterdir())) == 2 and not (tmp_path / "tables" / "gone").exists()
    assert Workspace(spark, f"file://{tmp_path}/other").names() == []


def test_declared_types_stay_with_a_table(spark, tmp_path):
    root = f"file://{tmp_path}/typed"
    first = Workspace(spark, root)
    first.save("t", spark.createDataFrame([("1.5", "31/12/2024", "x"), ("no", "2024-12-31", None)], "n string, d string, s string"))
    first.declare("t", {"n": "number", "d": {"type": "date", "format": "DD/MM/YYYY"}})
    day = datetime.date(2024, 12, 31)
    again = Workspace(spark, root)
    assert sorted(map(tuple, again.typed("t").collect()), key=str) == [(1.5, day, "x"), (None, None, None)]
    assert [tuple(r) for r in again.fields().collect()] == [("t", "n", "string", "number", None), ("t", "d", "string", "date", "DD/MM/YYYY"), ("t", "s", "string", None, None)]
    for wrong in ({"zzz": "number"}, {"n": "colour"}):
        with pytest.raises(ValueError):
            again.declare("t", wrong)
    with pytest.raises(ValueError):
        again.declare("other", {"n": "number"})
    # They belong to the name, whatever table it has; a field that is gone is left out; a new declaration replaces all.
    again.save("t", spark.createDataFrame([("7",)], "n string"))
    assert [tuple(r) for r in Workspace(spark, root).typed("t").collect()] == [(7.0,)]
    again.declare("t", {})
    assert Workspace(spark, root).typed("t").dtypes == [("n", "string")]
    again.declare("t", {"n": "number"})
    again.drop("t")
    assert again.fields().count() == 0 and Workspace(spark, root).fields().count() == 0
    plain = Workspace(spark)
    plain.attach("t", spark.createDataFrame([("7",)], "n string"))
    plain.declare("t", {"n": "number"})
    assert plain.typed("t").dtypes == [("n", "double")]


def test_sql_pages_with_totals(spark):
    ws = Workspace(spark)
    ws.attach("deals", spark.range(25).toDF("id"))
    assert [tuple(r) for r in ws.sql_page("SELECT id FROM deals WHERE id > 2", 3, 10, ["id"], total="n").collect()] == [(23, 22), (24, 22)]
    assert ws.sql_page("SELECT id FROM deals", 4, 10, ["id"], total="n").collect() == []
