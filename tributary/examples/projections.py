import pandas as pd
from pyspark.sql import functions as F

from tributary import UserFunction, Workspace, distinct_values, page, sort, transform, view, where
from tributary.examples.registry import leaf, query, table
from tributary.operators.ordered import Ordered


@query("view_select_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def view_select_distinct(spark, folder):
    fields = [{"field": "c_mktsegment", "distinct": True}, "c_name", {"field": "c_nationkey", "distinct": True}]
    return view(table(spark, folder, "customer"), fields)


@query("save_query_form", "SELECT DISTINCT o_orderpriority FROM orders")
def save_query_form(spark, folder):
    return distinct_values(table(spark, folder, "orders"), "o_orderpriority")


@query(
    "view_topk_multisort",
    """
    SELECT o_orderpriority, o_totalprice, o_orderkey FROM orders
    ORDER BY o_orderpriority ASC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25
    """,
)
def view_topk_multisort(spark, folder):
    sorts = [
        {"field": "o_orderpriority"},
        {"field": "o_totalprice", "ascending": False},
        {"field": "o_orderkey", "ascending": True},
        {"field": "o_totalprice", "ascending": True},
        {"field": "o_custkey"},
    ]
    return view(table(spark, folder, "orders"), ["o_orderpriority", "o_totalprice", "o_orderkey"], sorts, limit=25)


@query(
    "sort_nulls_last",
    """
    SELECT o_orderkey, price, row_number() OVER (ORDER BY price DESC NULLS LAST, o_orderkey) AS position
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price FROM orders)
    """,
)
def sort_nulls_last(spark, folder):
    price = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("price")
    orders = table(spark, folder, "orders").select("o_orderkey", price)
    return Ordered(orders, [("price", False), "o_orderkey"]).positions()


@query(
    "page_deep",
    """
    SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber
    LIMIT 40 OFFSET 40 * (SELECT (count(*) * 3 // 4) // 40 FROM lineitem)
    """,
)
def page_deep(spark, folder):
    lines = view(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber", "l_shipdate"])
    ordered = Ordered(lines, [("l_shipdate", False), "l_orderkey", "l_linenumber"])
    return ordered.page(ordered.size * 3 // 4 // 40 + 1, 40)


@query("sort_whole_table", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST")
def sort_whole_table(spark, folder):
    return sort(view(table(spark, folder, "customer"), ["c_custkey", "c_acctbal"]), "c_acctbal", ascending=False)


@query("page_3", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_3(spark, folder):
    return page(view(table(spark, folder, "orders"), ["o_orderkey", "o_totalprice"]), 3, 50, ["o_orderkey"])


@query(
    "page_with_total",
    """
    SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total_count
    FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 20
    """,
)
def page_with_total(spark, folder):
    customers = where(table(spark, folder, "customer"), leaf("c_acctbal", ">", 0))
    return page(view(customers, ["c_custkey", "c_acctbal"]), 2, 20, [("c_acctbal", False), "c_custkey"], "total_count")


@query(
    "transform_arith",
    """
    SELECT l_orderkey, l_linenumber, l_quantity + 1 AS plus_one, l_extendedprice - l_quantity AS less,
           round(l_extendedprice * (1 - l_discount), 4) AS net, l_quantity / 4 AS quarter,
           CAST(floor(l_partkey / 7) AS BIGINT) AS bucket, ((-l_partkey) % 7 + 7) % 7 AS wrapped,
           CAST(l_linenumber AS BIGINT) * l_linenumber AS squared,
           CASE WHEN l_quantity > 25 AND l_returnflag = 'R' THEN 'big return' ELSE 'other' END AS label
    FROM lineitem
    """,
)
def transform_arith(spark, folder):
    added = {
        "plus_one": "l_quantity + 1",
        "less": "l_extendedprice - l_quantity",
        "net": "l_extendedprice * (1 - l_discount)",
        "quarter": "l_quantity / 4",
        "bucket": "l_partkey // 7",
        "wrapped": "-l_partkey % 7",
        "squared": "l_linenumber ** 2",
        "label": "'big return' if l_quantity > 25 and l_returnflag == 'R' else 'other'",
    }
    lines = transform(table(spark, folder, "lineitem"), [{"outputField": n, "expression": e} for n, e in added.items()])
    return view(lines.withColumn("net", F.round("net", 4)), ["l_orderkey", "l_linenumber", *added])


@query(
    "transform_errors_null",
    """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity / (l_linenumber - 1) END AS ratio,
           CASE WHEN l_linenumber = 2 THEN NULL ELSE l_partkey % (l_linenumber - 2) + CASE
                WHEN l_linenumber = 1 AND l_partkey % (l_linenumber - 2) <> 0 THEN l_linenumber - 2 ELSE 0 END END AS rest,
           CASE WHEN l_orderkey % 1000 <> 0 THEN 9223372036854775807 END AS too_large
    FROM lineitem
    """,
)
def transform_errors_null(spark, folder):
    added = {
        "ratio": "l_quantity / (l_linenumber - 1)",
        "rest": "l_partkey % (l_linenumber - 2)",
        "too_large": "9223372036854775807 + (1 if l_orderkey % 1000 == 0 else 0)",
    }
    lines = transform(table(spark, folder, "lineitem"), [{"outputField": n, "expression": e} for n, e in added.items()])
    return view(lines, ["l_orderkey", "l_linenumber", *added])


@query(
    "transform_concat_var",
    """
    SELECT c_custkey, 'no. ' || c_custkey || ': ' || c_name AS label, c_acctbal * 1.5 AS scaled,
           c_mktsegment IN ('BUILDING', 'MACHINERY') AS listed, upper(c_mktsegment) AS c_mktsegment
    FROM customer
    """,
)
def transform_concat_var(spark, folder):
    variables = {"word": "no. ", "rate": 1.5, "segments": ["BUILDING", "MACHINERY"]}
    mappings = [
        {"outputField": "label", "expression": "{word} || c_custkey || ': ' || c_name"},
        {"outputField": "scaled", "expression": "c_acctbal * {rate}"},
        {"outputField": "listed", "expression": "c_mktsegment IN {segments}", "mode": "sql"},
        {"outputField": "c_mktsegment", "expression": "upper(c_mktsegment)"},
    ]
    named = transform(table(spark, folder, "customer"), mappings, variables)
    return view(named, ["c_custkey", "label", "scaled", "listed", "c_mktsegment"])


_SCALAR_SQL = """
    SELECT o_orderkey, round(o_totalprice / 3, 2) AS third, coalesce(NULLIF(o_orderstatus, 'P'), 'none') AS status,
           CAST(o_totalprice AS BIGINT) - CAST(o_totalprice AS BIGINT) % 10 AS tens
    FROM orders WHERE o_orderpriority LIKE '%H%' AND o_orderpriority NOT LIKE '%LOW%'
"""


@query("scalar_sql_functions", _SCALAR_SQL)
def scalar_sql_functions(spark, folder):
    tables = Workspace(spark)
    tables.attach("orders", table(spark, folder, "orders"))
    return tables.sql(_SCALAR_SQL.replace("CAST(o_totalprice AS BIGINT)", "CAST(round(o_totalprice) AS BIGINT)"))


def _net_price(row: dict):
    return round(row["l_extendedprice"] * (1 - row["l_discount"]), 4) if row["l_linenumber"] != 3 else 1 / 0


@query(
    "udf_row",
    """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_linenumber <> 3 THEN round(l_extendedprice * (1 - l_discount), 4) END AS net
    FROM lineitem
    """,
)
def udf_row(spark, folder):
    net = UserFunction(_net_price, "double", ["l_extendedprice", "l_discount", "l_linenumber"])
    lines = transform(table(spark, folder, "lineitem"), [{"outputField": "net", "expression": "net", "mode": "python"}], functions={"net": net})
    return view(lines, ["l_orderkey", "l_linenumber", "net"])


def _net_prices(batch: pd.DataFrame) -> pd.Series:
    return (batch["l_extendedprice"] * (1 - batch["l_discount"]) * (1 + batch["l_tax"])).round(6)


@query(
    "udf_vector",
    """
    SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem
    """,
)
def udf_vector(spark, folder):
    charge = UserFunction(_net_prices, "double", ["l_extendedprice", "l_discount", "l_tax"], batch=True)
    lines = transform(table(spark, folder, "lineitem"), [{"outputField": "charge", "expression": charge}])
    return view(lines, ["l_orderkey", "l_linenumber", "charge"])
