"""Nothing lost: long numbers, exact powers and medians, NaN as no value, quoted names, a single branch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary import Workspace, group, join, overlap, read_csv, transform, view, where, write_csv
from tributary.examples.registry import either, leaf, query, table
from tributary.sources.folders import shared_folder

LONG_ID = 1_800_000_000_000_000_000


@query(
    "read_csv_long_ids",
    f"SELECT o_orderkey + {LONG_ID} AS id, (o_orderkey + {LONG_ID})::VARCHAR || '0000000000' AS longer, o_totalprice AS price FROM orders",
)
def read_csv_long_ids(spark, folder):
    key = F.col("o_orderkey") + F.lit(LONG_ID)
    orders = table(spark, folder, "orders").select(key.alias("id"), F.concat(key.cast("string"), F.lit("0000000000")).alias("longer"), F.col("o_totalprice").alias("price"))
    path = shared_folder(spark, "csv")
    write_csv(orders, path)
    return read_csv(spark, path).withColumn("longer", F.col("longer").cast("string"))


@query(
    "join_text_key_exact",
    """
    SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_custkey % 3 <> 1
    """,
)
def join_text_key_exact(spark, folder):
    """Keys as text: every third customer's misses its number by less than a rounding."""
    key = F.col("c_nationkey").cast("string")
    spelt = F.when(F.col("c_custkey") % 3 == 0, F.concat(key, F.lit(".000"))).when(F.col("c_custkey") % 3 == 1, F.concat(key, F.lit(".00000000001"))).otherwise(key)
    customers = table(spark, folder, "customer").select("c_custkey", spelt.alias("nation"))
    return view(join(customers, table(spark, folder, "nation"), [("nation", "n_nationkey")], "inner"), ["c_custkey", "n_name"])


@query(
    "transform_exact_power",
    """
    SELECT l_orderkey, l_linenumber, CAST((l_partkey + 94906267)::HUGEINT * (l_partkey + 94906267) AS BIGINT) AS square,
           TRY_CAST(n * n * n * n * n * n AS BIGINT) AS sixth
    FROM (SELECT *, (l_orderkey + 1000)::HUGEINT AS n FROM lineitem)
    """,
)
def transform_exact_power(spark, folder):
    added = {"square": "(l_partkey + 94906267) ** 2", "sixth": "(l_orderkey + 1000) ** 6"}
    lines = transform(table(spark, folder, "lineitem"), [{"outputField": n, "expression": e} for n, e in added.items()])
    return view(lines, ["l_orderkey", "l_linenumber", *added])


def _holed(spark, folder):
    """Events with NaN in every seventh value and infinity in every eleventh."""
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(spark, folder, "events").select("event_id", "user_id", value.alias("value"))


_HOLED = "SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE ELSE value END AS value FROM events"


@query(
    "filter_nan",
    f"""
    SELECT event_id, 'above' AS test FROM ({_HOLED}) WHERE value > 50 UNION ALL SELECT event_id, 'least' FROM ({_HOLED}) WHERE value >= 50
    UNION ALL SELECT event_id, 'null' FROM ({_HOLED}) WHERE value IS NULL UNION ALL SELECT event_id, 'not null' FROM ({_HOLED}) WHERE value IS NOT NULL
    UNION ALL SELECT event_id, 'empty' FROM ({_HOLED}) WHERE value IS NULL UNION ALL SELECT event_id, 'either' FROM ({_HOLED}) WHERE value > 90 OR user_id < 5
    """,
)
def filter_nan(spark, folder):
    events = _holed(spark, folder)
    tests = {
        "above": leaf("value", ">", 50), "least": leaf("value", ">=", 50), "null": leaf("value", "is_null"), "not null": leaf("value", "is_not_null"),
        "empty": leaf("value", "is_empty"), "either": either(leaf("value", ">", 90), leaf("user_id", "<", 5)),
    }
    parts = [where(events, test).select("event_id", F.lit(name).alias("test")) for name, test in tests.items()]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return found


@query(
    "group_nan",
    """
    SELECT user_id, round(coalesce(sum(value), 0), 6) AS total, round(avg(value), 6) AS mean, count(value) AS filled, max(value) AS most, min(value) AS least, median(value) AS middle
    FROM (SELECT user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events) GROUP BY user_id
    """,
)
def group_nan(spark, folder):
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    events = table(spark, folder, "events").select("user_id", value.alias("value"))
    metrics = [("sum", "value", "total"), ("mean", "value", "mean"), ("count", "value", "filled"), ("max", "value", "most"), ("min", "value", "least"), ("median", "value", "middle")]
    return group(events, ["user_id"], metrics).withColumns({"total": F.round("total", 6), "mean": F.round("mean", 6)})


@query(
    "group_median_large",
    """
    SELECT l_linenumber, median(l_extendedprice * 1e303) AS huge, median((l_orderkey * 1000 + 4611686018427387904)::DOUBLE) AS long,
           median(l_quantity::DECIMAL(12, 2))::DOUBLE AS exact
    FROM lineitem GROUP BY l_linenumber
    """,
)
def group_median_large(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_linenumber", (F.col("l_extendedprice") * 1e303).alias("huge"), (F.col("l_orderkey") * 1000 + F.lit(1 << 62)).alias("long"), F.col("l_quantity").cast("decimal(12,2)").alias("exact")
    )
    return group(lines, ["l_linenumber"], [("median", x, x) for x in ("huge", "long", "exact")])


@query(
    "raw_sql_quoted",
    """
    SELECT "order", "line-item" FROM (SELECT l_orderkey AS "order", l_linenumber AS "line-item", l_quantity FROM lineitem) WHERE "line-item" > 2 AND l_quantity < 10
    """,
)
def raw_sql_quoted(spark, folder):
    tables = Workspace(spark)
    tables.attach("order-items", table(spark, folder, "lineitem").withColumnsRenamed({"l_orderkey": "order", "l_linenumber": "line-item"}))
    return tables.sql('SELECT "order", "line-item" FROM "order-items" WHERE "line-item" > 2 AND l_quantity < 10')


@query("overlap_single", "SELECT count(*) AS branch_rows, 0::BIGINT AS pairs FROM orders WHERE o_totalprice > 100000")
def overlap_single(spark, folder):
    """Fewer than two branches share nothing: no pairs, however many rows the branch has."""
    only = table(spark, folder, "orders").where("o_totalprice > 100000")
    pairs = overlap(spark, [("only", only)])
    return only.agg(F.count(F.lit(1)).alias("branch_rows")).crossJoin(pairs.agg(F.count(F.lit(1)).alias("pairs")))


@query("preview_orders", "SELECT 50::BIGINT AS shown, 50::BIGINT AS known")
def preview_orders(spark, folder):
    """A preview of a table larger than the preview: how many rows it shows, and how many of them the table has."""
    from tributary.operators.view import preview

    orders = table(spark, folder, "orders")
    shown = preview(orders, 50)
    keys = orders.select(F.col("o_orderkey").alias("key")).distinct()
    return shown.join(keys, shown["o_orderkey"] == keys["key"], "left").agg(F.count(F.lit(1)).alias("shown"), F.count("key").alias("known"))


@query(
    "join_left_spread",
    """
    SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey
    """,
)
def join_left_spread(spark, folder):
    """The way for sides too large to broadcast, with hot keys spread."""
    joined = join(table(spark, folder, "customer"), table(spark, folder, "orders"), [("c_custkey", "o_custkey")], "left", spread=True)
    return view(joined, ["c_custkey", "o_orderkey", "o_totalprice"])


@query("workspace_reopened", "SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def workspace_reopened(spark, folder):
    """A table that one workspace saves and replaces, read by another one opened on the same root."""
    root = shared_folder(spark, "lasting")
    first = Workspace(spark, root)
    first.save("orders-kept", table(spark, folder, "orders").limit(1))
    first.save("orders-kept", where(table(spark, folder, "orders"), leaf("o_totalprice", ">", 100000)))
    return group(Workspace(spark, root).table("orders-kept"), ["o_orderstatus"], [("count", "*", "orders")])
