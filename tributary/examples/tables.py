from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary import Workspace, cast_fields, clean_nonfinite, read_csv, write_csv
from tributary.examples.registry import query, table
from tributary.sources.folders import shared_folder

_REPORT_SQL = """
    SELECT n.n_name, COUNT(*) AS customers, ROUND(AVG(c.c_acctbal), 2) AS avg_balance, MAX(COALESCE(c.c_mktsegment, '')) AS last_segment
    FROM customer c INNER JOIN nation n ON c.c_nationkey = n.n_nationkey
    WHERE c.c_name LIKE '%1%' AND c.c_mktsegment NOT LIKE 'AUTO%'
    GROUP BY n.n_name HAVING COUNT(*) >= 3 ORDER BY customers DESC, n.n_name LIMIT 12
"""


@query("raw_sql", _REPORT_SQL)
def raw_sql(spark, folder):
    tables = Workspace(spark)
    for name in ("customer", "nation"):
        tables.attach(name, table(spark, folder, name))
    return tables.sql(_REPORT_SQL)


@query(
    "raw_sql_parameters",
    "SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 350000 AND o_orderstatus = 'F' ORDER BY o_custkey LIMIT 20 OFFSET 20",
)
def raw_sql_parameters(spark, folder):
    tables = Workspace(spark)
    tables.attach("orders", table(spark, folder, "orders"))
    text = "SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status"
    return tables.sql_page(text, 2, 20, ["o_custkey"], {"least": 350000, "status": "F"})


@query(
    "sql_page_with_total",
    """
    SELECT l_orderkey, l_linenumber, l_quantity, (SELECT count(*) FROM lineitem WHERE l_quantity > 30) AS total_rows
    FROM lineitem WHERE l_quantity > 30 ORDER BY l_orderkey, l_linenumber LIMIT 50 OFFSET 100
    """,
)
def sql_page_with_total(spark, folder):
    tables = Workspace(spark)
    tables.attach("lineitem", table(spark, folder, "lineitem"))
    text = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > :least"
    return tables.sql_page(text, 3, 50, ["l_orderkey", "l_linenumber"], {"least": 30}, total="total_rows")


@query("declared_types", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ordered, o_totalprice AS price, o_totalprice > 150000 AS dear FROM orders")
def declared_types(spark, folder):
    """Field types declared for a table of texts, read by a workspace that is opened on the same root later."""
    root = shared_folder(spark, "declared")
    texts = table(spark, folder, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("ordered"), F.col("o_totalprice").cast("string").alias("price"), (F.col("o_totalprice") > 150000).cast("string").alias("dear")
    )
    first = Workspace(spark, root)
    first.save("orders", texts)
    first.declare("orders", {"ordered": {"type": "date", "format": "DD/MM/YYYY"}, "price": "number", "dear": "boolean"})
    return Workspace(spark, root).typed("orders")


@query(
    "read_csv_roundtrip",
    """
    SELECT c_custkey AS customer_key, CASE WHEN c_custkey % 6 <> 0 THEN c_name || ', "the" ' || c_mktsegment END AS full_name,
           CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS c_acctbal, c_acctbal > 0 AS positive
    FROM customer
    """,
)
def read_csv_roundtrip(spark, folder):
    label = F.concat("c_name", F.lit(', "the" '), "c_mktsegment")
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias(" customer key "),
        F.when(F.col("c_custkey") % 6 != 0, label).alias("full name"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        (F.col("c_acctbal") > 0).alias("positive"),
    )
    path = shared_folder(spark, "csv")
    write_csv(customers, path)
    return read_csv(spark, path)


@query(
    "read_csv_headers",
    """
    SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS note FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'late' FROM supplier WHERE s_suppkey % 2 = 1
    """,
)
def read_csv_headers(spark, folder):
    """A folder of files whose columns stand in another order, one of them in some files only."""
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    path = shared_folder(spark, "csv-headers")
    write_csv(suppliers.where("key % 2 = 0"), f"{path}/a")
    write_csv(suppliers.where("key % 2 = 1").select("balance", F.lit("late").alias("note"), "key", "name"), f"{path}/b")
    return read_csv(spark, [f"{path}/a", f"{path}/b"])


@query(
    "sql_refused",
    """
    SELECT 'select' AS statement, (SELECT count(*) FROM orders WHERE o_totalprice > 1000) AS row_count
    UNION ALL SELECT 'with', (SELECT count(DISTINCT o_custkey) FROM orders)
    UNION ALL SELECT 'window', (SELECT count(*) FROM orders)
    UNION ALL SELECT unnest(['no select list', 'open bracket', 'unknown column', 'unknown table', 'not grouped', 'two statements', 'misspelt', 'no query']), NULL
    """,
)
def sql_refused(spark, folder):
    """How many rows statements over a table have that are accepted; those that are refused have none."""
    tables = Workspace(spark)
    tables.attach("orders", table(spark, folder, "orders"))
    statements = {
        "select": "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000",
        "with": "WITH t AS (SELECT DISTINCT o_custkey FROM orders) SELECT * FROM t ORDER BY o_custkey",
        "window": "SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders",
        "no select list": "SELECT FROM orders WHERE o_totalprice > 10",
        "open bracket": "SELECT (o_orderkey FROM orders",
        "unknown column": "SELECT price FROM orders",
        "unknown table": "SELECT 1 FROM no_such_table",
        "not grouped": "SELECT o_custkey, o_orderkey, count(*) FROM orders GROUP BY o_custkey",
        "two statements": "SELECT 1 FROM orders; SELECT 2 FROM orders",
        "misspelt": "SELEC o_orderkey FROM orders",
        "no query": "DROP VIEW orders",
    }

    def counted(name: str, text: str):
        try:
            found = tables.sql(text).agg(F.count(F.lit(1)).alias("row_count"))
        except PySparkException:
            return spark.range(1).select(F.lit(name).alias("statement"), F.lit(None).cast("long").alias("row_count"))
        return found.select(F.lit(name).alias("statement"), "row_count")

    return reduce(DataFrame.unionAll, [counted(*x) for x in statements.items()])


@query(
    "cast_formats",
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso_day, strftime(o_orderdate, '%Y-%m-%d') AS slash_day,
           CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS stamp,
           epoch_ms(o_orderdate) // 1000 AS seconds, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price,
           o_orderstatus = 'F' AS done
    FROM orders
    """,
)
def cast_formats(spark, folder):
    orders = table(spark, folder, "orders")
    at = F.col("o_orderdate")
    # The stored timestamps have no zone; the epoch is counted from their own calendar fields.
    seconds = F.unix_date(at.cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    texts = orders.select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso_day"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("slash_day"),
        F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss")).otherwise("not a date").alias("stamp"),
        (seconds * 1000).cast("string").alias("seconds"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice").cast("string")).otherwise("n/k").alias("price"),
        F.when(F.col("o_orderstatus") == "F", "True").otherwise("False").alias("done"),
    )
    typed = cast_fields(
        texts,
        {
            "iso_day": {"type": "date", "format": "YYYY-MM-DD"},
            "slash_day": {"type": "date", "format": "DD/MM/YYYY"},
            "stamp": {"type": "timestamp", "format": "YYYY/MM/DD HH:mm:ss"},
            "seconds": {"type": "timestamp", "format": "Timestamp (ms)"},
            "price": "number",
            "done": "boolean",
        },
    )
    return typed.withColumns(
        {
            "iso_day": F.date_format("iso_day", "yyyy-MM-dd"),
            "slash_day": F.date_format("slash_day", "yyyy-MM-dd"),
            "stamp": F.date_format("stamp", "yyyy-MM-dd HH:mm:ss"),
            "seconds": F.unix_seconds("seconds"),
        }
    )


@query(
    "clean_nonfinite",
    """
    SELECT event_id, CASE WHEN event_id % 5 NOT IN (1, 2, 3) THEN value END AS value FROM events
    """,
)
def clean_nonfinite_query(spark, folder):
    step = F.col("event_id") % 5
    dirty = (
        F.when(step == 1, F.lit(float("nan")))
        .when(step == 2, F.lit(float("inf")))
        .when(step == 3, F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    return clean_nonfinite(table(spark, folder, "events").select("event_id", dirty.alias("value")))


@query(
    "inventory",
    """
    SELECT 'orders' AS table_name, count(*) AS row_count, 6 AS column_count FROM orders
    UNION ALL SELECT 'customer', count(*), 5 FROM customer
    UNION ALL SELECT 'documents', count(*), 5 FROM documents
    UNION ALL SELECT 'events', count(*), 6 FROM events
    """,
)
def inventory(spark, folder):
    tables = Workspace(spark)
    for name in ("orders", "customer", "documents", "events"):
        tables.attach(name, table(spark, folder, name))
    return tables.inventory()


@query("preview", "SELECT n_nationkey, n_name, n_regionkey FROM nation LIMIT 50")
def preview_query(spark, folder):
    tables = Workspace(spark)
    tables.attach("nation", table(spark, folder, "nation"))
    return tables.preview("nation")


@query(
    "ingest_log",
    """
    SELECT 'orders.parquet' AS file_name, 'orders.parquet' AS dataset_name, 'orders' AS table_name, count(*) AS rows FROM orders
    UNION ALL SELECT 'orders.parquet', 'all-orders', 'all-orders', count(*) FROM orders
    UNION ALL SELECT 'part.parquet', 'part.parquet', 'part', count(*) FROM part
    """,
)
def ingest_log(spark, folder):
    tables = Workspace(spark)
    tables.ingest(f"{folder}/orders.parquet")
    tables.ingest(f"{folder}/orders.parquet", "all-orders")
    tables.ingest(f"{folder}/part.parquet")
    return tables.ingest_log().drop("loaded_at")


@query("register_replace", "SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def register_replace(spark, folder):
    """A table replaced by a result computed from itself, then queried under its own name."""
    tables = Workspace(spark)
    tables.save("busy-orders", table(spark, folder, "orders"))
    tables.save("busy-orders", tables.table("busy-orders").where("o_totalprice > 100000"))
    return tables.sql("SELECT o_orderstatus, count(*) AS orders FROM `busy-orders` GROUP BY o_orderstatus")
