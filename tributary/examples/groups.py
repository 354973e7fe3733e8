from pyspark.sql import functions as F

from tributary import group, overlap, view, where
from tributary.examples.registry import both, either, leaf, query, table
from tributary.operators.view import distinct_values


@query(
    "group_multi",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price,
           count(l_discount) AS discounts, count(*) AS lines, min(l_shipdate)::VARCHAR AS first_ship,
           max(l_extendedprice) AS max_price, min(l_partkey) AS min_part
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def group_multi(spark, folder):
    grouped = group(
        table(spark, folder, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        [
            {"field": "l_quantity", "func": "sum", "alias": "sum_qty"},
            {"field": "l_extendedprice", "func": "mean", "alias": "avg_price"},
            {"field": "l_discount", "func": "count", "alias": "discounts"},
            {"field": "*", "func": "count", "alias": "lines"},
            {"field": "l_shipdate", "func": "min", "alias": "first_ship"},
            {"field": "l_extendedprice", "func": "max", "alias": "max_price"},
            {"field": "l_partkey", "func": "min", "alias": "min_part"},
        ],
    )
    return grouped.withColumns(
        {
            "sum_qty": F.round("sum_qty", 2),
            "avg_price": F.round("avg_price", 4),
            "first_ship": F.date_format("first_ship", "yyyy-MM-dd HH:mm:ss"),
        }
    )


@query(
    "group_null_keys",
    """
    SELECT k, CAST(coalesce(sum(v), 0) AS BIGINT) AS total, count(v) AS filled FROM (
      SELECT NULLIF(o_orderpriority, '5-LOW') AS k, CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '2-HIGH' THEN o_custkey END AS v
      FROM orders) WHERE k IS NOT NULL GROUP BY k
    """,
)
def group_null_keys(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("k"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "2-HIGH"), F.col("o_custkey")).alias("v"),
    )
    return group(orders, ["k"], [("sum", "v", "total"), ("count", "v", "filled")])


@query(
    "group_keep_null_keys",
    "SELECT NULLIF(o_orderpriority, '5-LOW') AS k, count(*) AS orders FROM orders GROUP BY 1",
)
def group_keep_null_keys(spark, folder):
    orders = table(spark, folder, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("k"))
    return group(orders, ["k"], [("count", "*", "orders")], keep_null_groups=True)


@query(
    "group_first_last",
    """
    SELECT user_id, arg_min(event_type, (ts, event_id)) FILTER (WHERE event_type IS NOT NULL) AS first_type,
           arg_max(value, (ts, event_id)) AS last_value
    FROM (SELECT user_id, ts, event_id, NULLIF(event_type, 'click') AS event_type, value FROM events) GROUP BY user_id
    """,
)
def group_first_last(spark, folder):
    events = table(spark, folder, "events").withColumn("event_type", F.nullif("event_type", F.lit("click")))
    metrics = [("first", "event_type", "first_type"), ("last", "value", "last_value")]
    return group(events, ["user_id"], metrics, order_by=["ts", "event_id"])


@query(
    "group_stats",
    """
    SELECT l_returnflag, median(l_extendedprice) AS mid_price, round(stddev_samp(l_quantity), 6) AS std_qty,
           round(var_samp(l_quantity), 6) AS var_qty, count(DISTINCT l_partkey) AS parts
    FROM lineitem GROUP BY l_returnflag
    """,
)
def group_stats(spark, folder):
    metrics = [
        ("median", "l_extendedprice", "mid_price"),
        ("std", "l_quantity", "std_qty"),
        ("var", "l_quantity", "var_qty"),
        ("nunique", "l_partkey", "parts"),
    ]
    grouped = group(table(spark, folder, "lineitem"), ["l_returnflag"], metrics)
    return grouped.withColumns({"std_qty": F.round("std_qty", 6), "var_qty": F.round("var_qty", 6)})


@query(
    "group_product_any_all",
    """
    SELECT o_custkey, round(product(CASE WHEN o_orderstatus = 'F' THEN 2.0 ELSE 1.0 END), 2) AS doubled,
           bool_or(o_totalprice > 400000) AS any_big, bool_and(o_totalprice > 50000) AS all_big,
           median(o_totalprice) AS mid
    FROM orders GROUP BY o_custkey
    """,
)
def group_product_any_all(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_custkey",
        "o_totalprice",
        F.when(F.col("o_orderstatus") == "F", 2.0).otherwise(1.0).alias("factor"),
        (F.col("o_totalprice") > 400000).alias("big"),
        (F.col("o_totalprice") > 50000).alias("some"),
    )
    metrics = [
        ("prod", "factor", "doubled"),
        ("any", "big", "any_big"),
        ("all", "some", "all_big"),
        ("median", "o_totalprice", "mid"),
    ]
    return group(orders, ["o_custkey"], metrics).withColumn("doubled", F.round("doubled", 2))


@query(
    "group_global",
    """
    SELECT round(sum(l_quantity), 2) AS total, round(avg(l_discount), 6) AS avg_discount, count(*) AS lines,
           median(l_quantity) AS mid FROM lineitem
    """,
)
def group_global(spark, folder):
    metrics = [("sum", "l_quantity", "total"), ("mean", "l_discount", "avg_discount"), ("count", "*", "lines"), ("median", "l_quantity", "mid")]
    totals = group(table(spark, folder, "lineitem"), [], metrics)
    return totals.withColumns({"total": F.round("total", 2), "avg_discount": F.round("avg_discount", 6)})


@query("group_keys_only", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def group_keys_only(spark, folder):
    return group(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(
    "group_having",
    """
    SELECT o_custkey, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders
    GROUP BY o_custkey, o_orderpriority
    HAVING count(*) >= 2 AND sum(o_totalprice) < 900000 AND o_orderpriority ILIKE '%-h%' AND o_orderpriority <> '5-LOW'
      AND count(*) <> 7 AND o_custkey > 50
    """,
)
def group_having(spark, folder):
    having = [
        {"metricAlias": "orders", "operator": ">=", "value": "2"},
        {"metricAlias": "total", "operator": "<", "value": "{ceiling}"},
        {"metricAlias": "o_orderpriority", "operator": "contains", "value": "-H"},
        {"metricAlias": "o_orderpriority", "operator": "!=", "value": "5-LOW"},
        {"metricAlias": "orders", "operator": "!=", "value": 7},
        {"metricAlias": "o_custkey", "operator": ">", "value": 50},
    ]
    metrics = [("count", "*", "orders"), ("sum", "o_totalprice", "total")]
    grouped = group(
        table(spark, folder, "orders"), ["o_custkey", "o_orderpriority"], metrics, having, variables={"ceiling": 900000}
    )
    return grouped.withColumn("total", F.round("total", 2))


@query(
    "overlap_pairs",
    """
    WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000),
         b AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'),
         c AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice <= 150000)
    SELECT 'large' AS branch_a, 'finished' AS branch_b, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared_rows
    UNION ALL SELECT 'large', 'small', (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM c))
    UNION ALL SELECT 'finished', 'small', (SELECT count(*) FROM (SELECT * FROM b INTERSECT SELECT * FROM c))
    """,
)
def overlap_pairs(spark, folder):
    orders, fields = table(spark, folder, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"]
    tests = {
        "large": leaf("o_totalprice", ">", 200000),
        "finished": leaf("o_orderstatus", "=", "F"),
        "small": leaf("o_totalprice", "<=", 150000),
    }
    return overlap(spark, [(name, view(where(orders, test), fields)) for name, test in tests.items()])


def _rich(spark, folder):
    """Captured column: keys of customers with a large balance, one of them null."""
    rich = where(table(spark, folder, "customer"), leaf("c_acctbal", ">", 7000))
    return distinct_values(rich.select(F.nullif("c_custkey", F.lit(10)).alias("c_custkey")), "c_custkey")


_CUST = "CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END"
_RICH = "SELECT NULLIF(c_custkey, 10) AS k FROM customer WHERE c_acctbal > 7000"
_HAS = f"EXISTS (SELECT 1 FROM ({_RICH}) r WHERE r.k IS NOT DISTINCT FROM o.cust)"


def _orders_with_null_customers(spark, folder):
    cust = F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("cust")
    return table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", cust)


@query("variable_save_in", f"SELECT o_orderkey, o_orderstatus, cust FROM (SELECT *, {_CUST} AS cust FROM orders) o WHERE {_HAS}")
def variable_save_in(spark, folder):
    orders = _orders_with_null_customers(spark, folder)
    return where(orders, leaf("cust", "in_variable", "rich"), {"rich": _rich(spark, folder)})


@query("variable_not_in", f"SELECT o_orderkey, o_orderstatus, cust FROM (SELECT *, {_CUST} AS cust FROM orders) o WHERE NOT {_HAS}")
def variable_not_in(spark, folder):
    orders = _orders_with_null_customers(spark, folder)
    return where(orders, both(leaf("cust", "not_in_variable", "{rich}")), {"rich": _rich(spark, folder)})


@query(
    "variable_in_or",
    f"""
    SELECT o_orderkey, o_orderstatus, cust FROM (SELECT *, {_CUST} AS cust FROM orders) o
    WHERE (o_orderstatus = 'P' OR {_HAS}) AND (o_orderstatus IN ('P', 'F') OR NOT {_HAS})
    """,
)
def variable_in_or(spark, folder):
    tests = both(
        either(leaf("o_orderstatus", "=", "P"), leaf("cust", "in_variable", "rich")),
        either(
            leaf("o_orderstatus", "in_list", "statuses", valueType="variable"),
            leaf("cust", "not_in_variable", "rich", valueType="variable"),
        ),
    )
    variables = {"rich": _rich(spark, folder), "statuses": "P, F"}
    return where(_orders_with_null_customers(spark, folder), tests, variables)


@query(
    "variable_list",
    """
    SELECT c_custkey, c_mktsegment, c_nationkey FROM customer
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3, 5, 8, 13) AND c_acctbal > 1000
    """,
)
def variable_list(spark, folder):
    variables = {"segments": ["BUILDING", "MACHINERY"], "nations": "1,2,3,5,8,13", "least": 1000}
    tests = both(
        leaf("c_mktsegment", "in_variable", "segments"),
        leaf("c_nationkey", "in_variable", "nations"),
        leaf("c_acctbal", ">", "{least}"),
    )
    kept = where(table(spark, folder, "customer"), tests, variables)
    return view(kept, ["c_custkey", "c_mktsegment", "c_nationkey"])


@query(
    "variable_top_n",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (
      SELECT o_custkey FROM (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
      ORDER BY round(total, 2) DESC, o_custkey LIMIT 20)
    """,
)
def variable_top_n(spark, folder):
    orders = table(spark, folder, "orders")
    totals = group(orders, ["o_custkey"], [("sum", "o_totalprice", "total")]).withColumn("total", F.round("total", 2))
    top = view(totals, sorts=[("total", False), ("o_custkey", True)], limit=20)
    kept = where(orders, leaf("o_custkey", "in_variable", "top"), {"top": distinct_values(top, "o_custkey")})
    return view(kept, ["o_orderkey", "o_custkey", "o_totalprice"])


@query(
    "variable_captured_text",
    """
    SELECT p_partkey, p_name FROM part WHERE EXISTS (
      SELECT 1 FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS word FROM part WHERE p_size = 1) w
      WHERE contains(lower(p_name), lower(w.word)))
      AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part WHERE p_size = 2 AND p_retailprice < 910) w
      WHERE starts_with(p_name, w.word))
    """,
)
def variable_captured_text(spark, folder):
    part = table(spark, folder, "part")
    second = F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word")
    first = F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")
    variables = {
        "nouns": distinct_values(where(part, leaf("p_size", "=", 1)).select(second), "word"),
        "adjectives": distinct_values(where(part, both(leaf("p_size", "=", 2), leaf("p_retailprice", "<", 910))).select(first), "word"),
    }
    kept = where(part, leaf("p_name", "contains", "{nouns}"), variables)
    starting = where(kept, leaf("p_name", "starts_with", "{adjectives}"), variables)
    rest = kept.join(starting.select("p_partkey"), "p_partkey", "left_anti")
    return view(rest, ["p_partkey", "p_name"])
