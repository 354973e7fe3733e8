from pyspark.sql import functions as F

from tributary import group, join, search, view, where
from tributary.examples.registry import both, either, leaf, query, table
from tributary.functions.predicates import condition


@query(
    "flagship",
    """
    SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue,
           round(avg(o_totalprice), 4) AS avg_price
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_totalprice > 100000 AND (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')
    GROUP BY c_mktsegment HAVING count(*) >= 10
    ORDER BY revenue DESC, c_mktsegment LIMIT 3
    """,
)
def flagship(spark, folder):
    tests = both(
        leaf("o_totalprice", ">", 100000),
        either(leaf("o_orderstatus", "=", "F"), leaf("o_orderpriority", "=", "1-URGENT")),
    )
    joined = join(where(table(spark, folder, "orders"), tests), table(spark, folder, "customer"), "o_custkey = c_custkey", "inner")
    grouped = group(
        joined,
        ["c_mktsegment"],
        [("count", "*", "orders"), ("sum", "o_totalprice", "revenue"), ("mean", "o_totalprice", "avg_price")],
        having=[{"metricAlias": "orders", "operator": ">=", "value": 10}],
    )
    rounded = grouped.select(
        "c_mktsegment", "orders", F.round("revenue", 2).alias("revenue"), F.round("avg_price", 4).alias("avg_price")
    )
    return view(rounded, sorts=[("revenue", False), ("c_mktsegment", True)], limit=3)


@query(
    "filter_numeric_ops",
    """
    SELECT count(*) FILTER (WHERE l_quantity = 20) AS eq, count(*) FILTER (WHERE l_quantity <> 20) AS ne,
           count(*) FILTER (WHERE l_quantity > 20) AS gt, count(*) FILTER (WHERE l_linenumber >= 3) AS ge,
           count(*) FILTER (WHERE l_discount < 0.05) AS lt, count(*) FILTER (WHERE l_partkey <= 100) AS le
    FROM lineitem
    """,
)
def filter_numeric_ops(spark, folder):
    lines = table(spark, folder, "lineitem")
    tests = {
        "eq": leaf("l_quantity", "=", 20),
        "ne": leaf("l_quantity", "!=", "20", dataType="number"),
        "gt": leaf("l_quantity", ">", 20.0),
        "ge": leaf("l_linenumber", ">=", "3", dataType="number"),
        "lt": leaf("l_discount", "<", 0.05),
        "le": leaf("l_partkey", "<=", 100),
    }
    return lines.agg(*[F.count_if(condition(lines.schema, t)).alias(n) for n, t in tests.items()])


@query(
    "filter_range_rows",
    """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_quantity >= 49 AND l_discount < 0.02 AND l_linenumber <> 1
    """,
)
def filter_range_rows(spark, folder):
    tests = both(leaf("l_quantity", ">=", 49), leaf("l_discount", "<", 0.02), leaf("l_linenumber", "!=", 1))
    return view(where(table(spark, folder, "lineitem"), tests), ["l_orderkey", "l_linenumber", "l_quantity"])


@query(
    "filter_neq_keeps_null",
    """
    SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS cust
    FROM orders
    WHERE NULLIF(o_orderstatus, 'P') IS DISTINCT FROM 'F'
      AND (CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END) IS DISTINCT FROM 10
    """,
)
def filter_neq_keeps_null(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("cust"),
    )
    return where(orders, both(leaf("status", "!=", "F"), leaf("cust", "!=", 10)))


@query(
    "filter_text_ops",
    """
    SELECT p_partkey, p_name, p_brand, p_type FROM part
    WHERE p_type <> 'ECONOMY' AND starts_with(p_brand, 'Brand#1')
      AND (lower(p_name) LIKE '%wi%' OR p_name LIKE '%ring')
      AND NOT (lower(p_name) LIKE '%small%')
    """,
)
def filter_text_ops(spark, folder):
    tests = both(
        leaf("p_type", "!=", "ECONOMY"),
        leaf("p_brand", "starts_with", "Brand#1"),
        either(leaf("p_name", "contains", "WI"), leaf("p_name", "ends_with", "ring")),
        leaf("p_name", "not_contains", "Small"),
    )
    return view(where(table(spark, folder, "part"), tests), ["p_partkey", "p_name", "p_brand", "p_type"])


@query(
    "filter_contains_any",
    """
    SELECT p_partkey, p_name FROM part
    WHERE (p_name ILIKE '%red%' OR p_name ILIKE '%blue%') AND NOT (p_name ILIKE '%ring%' OR p_name ILIKE '%bolt%')
    """,
)
def filter_contains_any(spark, folder):
    tests = both(leaf("p_name", "contains", "Red, BLUE"), leaf("p_name", "not_contains", ["ring", "bolt"]))
    return view(where(table(spark, folder, "part"), tests), ["p_partkey", "p_name"])


@query(
    "filter_contains_documents",
    """
    SELECT doc_id, lang, n_chars FROM documents
    WHERE (contains(lower(text), 'license') OR contains(lower(text), '@')) AND lang <> 'en'
    """,
)
def filter_contains_documents(spark, folder):
    tests = both(leaf("text", "contains", "LICENSE,@"), leaf("lang", "!=", "en"))
    return view(where(table(spark, folder, "documents"), tests), ["doc_id", "lang", "n_chars"])


@query(
    "filter_contains_regex",
    "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^(red|blue) .*t$')",
)
def filter_contains_regex(spark, folder):
    kept = where(table(spark, folder, "part"), leaf("p_name", "contains", ["^(RED|BLUE) .*t$"]), regex=True)
    return view(kept, ["p_partkey", "p_name"])


@query(
    "filter_in_list",
    """
    SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status FROM orders
    WHERE o_custkey IN (10, 25, 70, 101, 250, 260)
       OR (o_orderpriority IN ('1-URGENT', '2-HIGH') AND coalesce(NULLIF(o_orderstatus, 'P') NOT IN ('F', 'O'), true))
    """,
)
def filter_in_list(spark, folder):
    orders = table(spark, folder, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    tests = either(
        leaf("o_custkey", "in_list", "10, 25,70,101,250,260", dataType="number"),
        both(leaf("o_orderpriority", "in_list", ["1-URGENT", "2-HIGH"]), leaf("status", "not_in_list", "F,O")),
    )
    return view(where(orders, tests), ["o_orderkey", "status"])


_EMPTIED = "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END"


@query(
    "filter_null_empty",
    f"""
    WITH t AS (SELECT {_EMPTIED} AS note FROM customer)
    SELECT count(*) FILTER (WHERE note IS NULL) AS nulls, count(*) FILTER (WHERE note IS NOT NULL) AS not_nulls,
           count(*) FILTER (WHERE note IS NULL OR note = '') AS empties,
           count(*) FILTER (WHERE note IS NOT NULL AND note <> '') AS filled
    FROM t
    """,
)
def filter_null_empty(spark, folder):
    notes = table(spark, folder, "customer").select(F.expr(_EMPTIED).alias("note"))
    ops = {"nulls": "is_null", "not_nulls": "is_not_null", "empties": "is_empty", "filled": "is_not_empty"}
    return notes.agg(*[F.count_if(condition(notes.schema, leaf("note", op))).alias(n) for n, op in ops.items()])


@query(
    "filter_nested_groups",
    """
    SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem
    WHERE true AND ((l_returnflag = 'R' AND (l_quantity < 5 OR l_tax >= 0.07)) OR (l_linestatus = 'O' AND l_discount = 0.1))
      AND NOT (l_linenumber = 1) AND (false OR l_linenumber > 2)
    """,
)
def filter_nested_groups(spark, folder):
    tests = both(
        leaf("", "always_true"),
        either(
            both(leaf("l_returnflag", "=", "R"), either(leaf("l_quantity", "<", 5), leaf("l_tax", ">=", 0.07))),
            both(leaf("l_linestatus", "=", "O"), leaf("l_discount", "=", 0.1)),
        ),
        leaf("l_linenumber", "!=", 1),
        either(leaf("", "always_false"), leaf("l_linenumber", ">", 2)),
        both(),
    )
    kept = where(table(spark, folder, "lineitem"), tests)
    return view(kept, ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"])


@query(
    "filter_bool_date",
    """
    SELECT event_id, event_type FROM events
    WHERE (value > 50) IS TRUE AND ts > TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-25 12:00:00'
      AND CAST(ts AS DATE) <> DATE '2024-01-10'
    UNION ALL
    SELECT event_id, 'on the day' AS event_type FROM events
    WHERE (value > 50) IS NOT TRUE AND CAST(ts AS DATE) = DATE '2024-01-10'
    """,
)
def filter_bool_date(spark, folder):
    events = table(spark, folder, "events").withColumn("large", F.col("value") > 50)
    between = both(
        leaf("large", "is_true"),
        leaf("ts", "after", "2024-01-05"),
        leaf("ts", "before", "2024-01-25 12:00:00"),
        leaf("ts", "!=", "2024-01-10", dataType="timestamp"),
    )
    on_day = both(leaf("large", "is_false"), leaf("ts", "=", "2024-01-10"))
    first = view(where(events, between), ["event_id", "event_type"])
    return first.unionAll(where(events, on_day).select("event_id", F.lit("on the day").alias("event_type")))


@query(
    "filter_json",
    """
    SELECT event_id, props FROM events
    WHERE json_exists(props, '$.k') AND contains(lower(props), '7') AND NOT json_exists(props, '$.missing')
    """,
)
def filter_json(spark, folder):
    events = table(spark, folder, "events")
    kept = where(events, both(leaf("props", "has_key", "k"), leaf("props", "contains", "7", dataType="json")))
    return view(kept.where(~condition(events.schema, leaf("props", "has_key", "missing"))), ["event_id", "props"])


@query(
    "filter_chain",
    """
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
    WHERE o_orderstatus = 'O' AND o_totalprice >= 200000 AND o_orderdate >= TIMESTAMP '1996-01-01'
    """,
)
def filter_chain(spark, folder):
    kept = where(table(spark, folder, "orders"), leaf("o_orderstatus", "=", "O"))
    kept = where(kept, leaf("o_totalprice", ">=", "200000", dataType="number"))
    kept = where(kept, leaf("o_orderdate", ">=", "1996-01-01"))
    return view(kept, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query(
    "search_any_column",
    """
    SELECT 'nation' AS source, CAST(n_nationkey AS BIGINT) AS id FROM nation
    WHERE contains(lower(n_name), '1') OR contains(CAST(n_nationkey AS VARCHAR), '1') OR contains(CAST(n_regionkey AS VARCHAR), '1')
    UNION ALL
    SELECT 'part' AS source, p_partkey AS id FROM part
    WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')
    UNION ALL
    SELECT 'brand' AS source, p_partkey AS id FROM part WHERE starts_with(p_brand, 'Brand#2')
    UNION ALL
    SELECT 'type' AS source, p_partkey AS id FROM part WHERE lower(p_type) = 'economy'
    """,
)
def search_any_column(spark, folder):
    nation, part = table(spark, folder, "nation"), table(spark, folder, "part")

    def found(df, key, source, *args, **options):
        return df.where(search(df.schema, *args, **options)).select(F.lit(source).alias("source"), F.col(key).cast("long").alias("id"))

    words = part.select("p_partkey", "p_name", "p_brand", "p_type")
    texts = words.where(search(words.drop("p_partkey").schema, " RED "))
    return (
        found(nation, "n_nationkey", "nation", "1")
        .unionAll(texts.select(F.lit("part").alias("source"), F.col("p_partkey").alias("id")))
        .unionAll(found(part, "p_partkey", "brand", "Brand#2", "p_brand", "starts", case_sensitive=True))
        .unionAll(found(part, "p_partkey", "type", "economy", "p_type", "equals"))
    )


@query("filter_missing_column", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= 2")
def filter_missing_column(spark, folder):
    tests = both(leaf("no_such_column", "=", 1), leaf("r_regionkey", ">=", 2))
    return where(table(spark, folder, "region"), tests, on_missing="pass")
