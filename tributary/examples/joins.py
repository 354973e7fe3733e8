from pyspark.sql import functions as F

from tributary import detail_rows, exists, group, join, match_counts, nested_detail, transform, view, where
from tributary.examples.registry import both, either, leaf, query, table
from tributary.operators.text_match import text_matches


def _sides(spark, folder):
    """Orders and customers cut so that both sides have rows without a partner."""
    orders = where(table(spark, folder, "orders"), leaf("o_totalprice", ">", 250000))
    customers = where(table(spark, folder, "customer"), leaf("c_acctbal", ">", 3000))
    return (
        view(orders, ["o_orderkey", "o_custkey", "o_totalprice"]),
        view(customers, ["c_custkey", "c_name", "c_acctbal"]),
    )


def _join_sql(how: str) -> str:
    return f"""
    SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name, c_acctbal
    FROM (SELECT * FROM orders WHERE o_totalprice > 250000) o
    {how} JOIN (SELECT * FROM customer WHERE c_acctbal > 3000) c ON o_custkey = c_custkey
    """


@query("join_inner", _join_sql("INNER"))
def join_inner(spark, folder):
    return join(*_sides(spark, folder), "orders.o_custkey = customer.c_custkey", "inner")


@query("join_left", _join_sql("LEFT"))
def join_left(spark, folder):
    return join(*_sides(spark, folder), [("o_custkey", "c_custkey")])


@query("join_right", _join_sql("RIGHT"))
def join_right(spark, folder):
    return join(*_sides(spark, folder), "o_custkey = c_custkey", "RIGHT")


@query("join_full", _join_sql("FULL"))
def join_full(spark, folder):
    return join(*_sides(spark, folder), "o_custkey = c_custkey", "full")


@query(
    "join_same_key_full",
    """
    SELECT coalesce(o.custkey, c.custkey) AS custkey, o.orders, c.c_name
    FROM (SELECT o_custkey AS custkey, count(*) AS orders FROM orders WHERE o_totalprice > 300000 GROUP BY 1) o
    FULL JOIN (SELECT c_custkey AS custkey, c_name FROM customer WHERE c_acctbal < 5000) c ON o.custkey = c.custkey
    """,
)
def join_same_key_full(spark, folder):
    big = where(table(spark, folder, "orders"), leaf("o_totalprice", ">", 300000))
    orders = group(big.withColumnRenamed("o_custkey", "custkey"), ["custkey"], [("count", "*", "orders")])
    poor = where(table(spark, folder, "customer"), leaf("c_acctbal", "<", 5000))
    return join(orders, poor.select(F.col("c_custkey").alias("custkey"), "c_name"), "custkey", "full")


@query(
    "join_suffix",
    """
    SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS n_nationkey_other, b.n_name AS n_name_other
    FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey
    """,
)
def join_suffix(spark, folder):
    nation = table(spark, folder, "nation")
    return join(nation, nation, "n_regionkey", "inner", suffix="_other")


@query(
    "join_null_safe",
    """
    SELECT o.o_orderkey, o.k, c.c_custkey, c.ck
    FROM (SELECT o_orderkey, NULLIF(o_custkey, 10) AS k FROM orders) o
    JOIN (SELECT c_custkey, NULLIF(c_custkey, 20) AS ck FROM customer) c ON o.k IS NOT DISTINCT FROM c.ck
    """,
)
def join_null_safe(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.nullif("o_custkey", F.lit(10)).alias("k"))
    customers = table(spark, folder, "customer").select("c_custkey", F.nullif("c_custkey", F.lit(20)).alias("ck"))
    return join(orders, customers, "k = ck", "inner", null_safe=True)


@query(
    "join_branch",
    """
    WITH big AS (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity
                 FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150)
    SELECT o_orderkey, o_totalprice, lines, quantity FROM orders JOIN big ON o_orderkey = l_orderkey
    """,
)
def join_branch(spark, folder):
    big = group(
        table(spark, folder, "lineitem"),
        ["l_orderkey"],
        [("count", "*", "lines"), ("sum", "l_quantity", "quantity")],
        having=[{"metricAlias": "quantity", "operator": ">", "value": 150}],
    )
    joined = join(table(spark, folder, "orders"), big, "o_orderkey = l_orderkey", "inner")
    return view(joined, ["o_orderkey", "o_totalprice", "lines", "quantity"])


@query(
    "join_chain_self",
    """
    SELECT o_orderkey, c_name, a.n_name, r_name, b.n_name AS n_name_twin
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey
    JOIN region ON a.n_regionkey = r_regionkey
    LEFT JOIN nation b ON a.n_nationkey = b.n_regionkey
    WHERE o_totalprice > 400000
    """,
)
def join_chain_self(spark, folder):
    nation = table(spark, folder, "nation")
    big = where(table(spark, folder, "orders"), leaf("o_totalprice", ">", 400000))
    chain = join(big, table(spark, folder, "customer"), "o_custkey = c_custkey", "inner")
    chain = join(chain, nation, "c_nationkey = n_nationkey", "inner")
    chain = join(chain, table(spark, folder, "region"), "n_regionkey = r_regionkey", "inner")
    chain = join(chain, nation, [("n_nationkey", "n_regionkey")], "left", suffix="_twin")
    return view(chain, ["o_orderkey", "c_name", "n_name", "r_name", "n_name_twin"])


@query(
    "join_theta_multikey",
    """
    SELECT l_orderkey, l_linenumber, p_partkey, p_retailprice
    FROM lineitem JOIN part ON l_partkey = p_partkey AND l_extendedprice > p_retailprice AND l_quantity <> p_size
      AND p_size <= 20
    """,
)
def join_theta_multikey(spark, folder):
    on = "lineitem.l_partkey = part.p_partkey AND lineitem.l_extendedprice > part.p_retailprice AND part.p_size != lineitem.l_quantity AND part.p_size <= {largest}"
    joined = join(
        table(spark, folder, "lineitem"),
        table(spark, folder, "part"),
        on,
        "inner",
        variables={"largest": 20},
        left_names=["lineitem"],
        right_names=["part"],
    )
    return view(joined, ["l_orderkey", "l_linenumber", "p_partkey", "p_retailprice"])


@query(
    "join_theta_columns",
    """
    SELECT o_orderkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem
    ON o_orderkey = l_orderkey AND o_orderdate < l_shipdate AND o_totalprice >= l_extendedprice
    """,
)
def join_theta_columns(spark, folder):
    on = [("o_orderkey", "l_orderkey"), ("o_orderdate", "<", "l_shipdate"), ("o_totalprice", ">=", "l_extendedprice")]
    joined = join(table(spark, folder, "orders"), table(spark, folder, "lineitem"), on, "inner")
    return view(joined, ["o_orderkey", "l_linenumber", "l_extendedprice"])


@query("join_cross", "SELECT r_regionkey, r_name, n_nationkey, n_name, n_regionkey FROM region CROSS JOIN nation")
def join_cross(spark, folder):
    return join(table(spark, folder, "region"), table(spark, folder, "nation"), "1=1", "inner")


@query("join_cross_orders", "SELECT o_orderkey, o_totalprice, r_regionkey FROM orders CROSS JOIN region")
def join_cross_orders(spark, folder):
    crossed = join(table(spark, folder, "orders"), table(spark, folder, "region"), None, "cross")
    return view(crossed, ["o_orderkey", "o_totalprice", "r_regionkey"])


def _spans(spark, folder):
    """An hour around each costly event, and the events of small value."""
    events = table(spark, folder, "events")
    spans = events.where("value > 99").select(F.col("event_id").alias("span"), F.col("ts").alias("since"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("until"))
    return spans, events.where("value < 1").select("event_id", "ts", "user_id")


_SPAN_SQL = """
    WITH spans AS (SELECT event_id AS span, ts AS since, ts + INTERVAL 1 HOUR AS until FROM events WHERE value > 99),
         small AS (SELECT event_id, ts, user_id FROM events WHERE value < 1)
    SELECT span, event_id, user_id FROM small {} JOIN spans ON ts >= since AND ts < until {}
"""


@query("join_range_inner", _SPAN_SQL.format("", ""))
def join_range_inner(spark, folder):
    spans, small = _spans(spark, folder)
    return join(small, spans, "ts >= since AND ts < until", "inner").select("span", "event_id", "user_id")


@query("join_range_left", _SPAN_SQL.format("LEFT", "AND user_id % 2 = 0"))
def join_range_left(spark, folder):
    spans, small = _spans(spark, folder)
    joined = join(small, spans, "small.ts >= spans.since AND small.ts < spans.until AND small.user_id % 2 = 0", "left", left_names=["small"], right_names=["spans"])
    return joined.select("span", "event_id", "user_id")


@query("join_range_full", _SPAN_SQL.format("FULL", ""))
def join_range_full(spark, folder):
    spans, small = _spans(spark, folder)
    return join(spans, small, [("since", "<=", "ts"), ("until", ">", "ts")], "full").select("span", "event_id", "user_id")


@query(
    "join_range_prices",
    """
    SELECT c_custkey, p_partkey FROM (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0) c
    RIGHT JOIN part ON c_acctbal BETWEEN p_retailprice AND p_retailprice + p_size
    """,
)
def join_range_prices(spark, folder):
    customers = view(where(table(spark, folder, "customer"), leaf("c_acctbal", ">", 0)), ["c_custkey", "c_acctbal"])
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice", (F.col("p_retailprice") + F.col("p_size")).alias("upto"))
    joined = join(customers, parts, "c.c_acctbal BETWEEN p.p_retailprice AND p.upto", "right", left_names=["c"], right_names=["p"])
    return view(joined, ["c_custkey", "p_partkey"])


@query(
    "join_left_residual",
    """
    SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem
    ON o_orderkey = l_orderkey AND l_quantity + l_linenumber > 45 AND o_totalprice > l_extendedprice * 2
    """,
)
def join_left_residual(spark, folder):
    on = "orders.o_orderkey = lineitem.l_orderkey AND lineitem.l_quantity + lineitem.l_linenumber > 45 AND orders.o_totalprice > lineitem.l_extendedprice * 2"
    joined = join(table(spark, folder, "orders"), table(spark, folder, "lineitem"), on, "left", left_names=["orders"], right_names=["lineitem"], spread=True)
    return view(joined, ["o_orderkey", "l_linenumber"])


@query(
    "exists_basic",
    """
    SELECT l_orderkey, l_linenumber FROM lineitem sub WHERE EXISTS (
      SELECT 1 FROM orders main WHERE main.o_totalprice > 300000 AND sub.l_orderkey = main.o_orderkey)
    """,
)
def exists_basic(spark, folder):
    main = where(table(spark, folder, "orders"), leaf("o_totalprice", ">", 300000))
    return view(
        exists(table(spark, folder, "lineitem"), main, "main.o_orderkey = sub.l_orderkey"), ["l_orderkey", "l_linenumber"]
    )


def _link(field, operator, main_field=None):
    return {"field": field, "operator": operator, "mainField": main_field}


@query(
    "exists_tree",
    """
    SELECT l_orderkey, l_linenumber FROM lineitem sub WHERE EXISTS (
      SELECT 1 FROM orders main WHERE sub.l_orderkey = main.o_orderkey
        AND (sub.l_shipdate < main.o_orderdate OR sub.l_extendedprice * 1.0 >= main.o_totalprice
             OR (sub.l_partkey = main.o_custkey AND sub.l_returnflag IS NOT NULL AND sub.l_returnflag <> ''))
        AND sub.l_linestatus IS NOT NULL AND true)
    """,
)
def exists_tree(spark, folder):
    tree = both(
        either(
            _link("l_shipdate", "<", "o_orderdate"),
            _link("l_extendedprice", ">=", "o_totalprice"),
            both(_link("l_partkey", "=", "o_custkey"), _link("l_returnflag", "is_not_empty")),
        ),
        _link("l_linestatus", "is_not_null"),
        _link("", "always_true"),
    )
    kept = exists(table(spark, folder, "lineitem"), table(spark, folder, "orders"), "main.o_orderkey = sub.l_orderkey", tree)
    return view(kept, ["l_orderkey", "l_linenumber"])


@query(
    "exists_bounded_per_key",
    """
    SELECT l_orderkey, l_linenumber FROM lineitem sub WHERE EXISTS (
      SELECT 1 FROM orders main WHERE main.o_orderkey = sub.l_orderkey AND sub.l_extendedprice > main.o_totalprice)
    """,
)
def exists_bounded_per_key(spark, folder):
    tree = both(_link("l_orderkey", "=", "o_orderkey"), _link("l_extendedprice", ">", "o_totalprice"))
    return view(exists(table(spark, folder, "lineitem"), table(spark, folder, "orders"), tree=tree), ["l_orderkey", "l_linenumber"])


@query(
    "exists_range_only",
    """
    SELECT o_orderkey, o_totalprice FROM orders sub WHERE
      EXISTS (SELECT 1 FROM customer main WHERE sub.o_totalprice < main.c_acctbal)
      OR EXISTS (SELECT 1 FROM customer main WHERE sub.o_custkey = main.c_nationkey)
    """,
)
def exists_range_only(spark, folder):
    tree = either(_link("o_totalprice", "<", "c_acctbal"), _link("o_custkey", "=", "c_nationkey"))
    kept = exists(table(spark, folder, "orders"), table(spark, folder, "customer"), tree=tree)
    return view(kept, ["o_orderkey", "o_totalprice"])


@query(
    "exists_text_links",
    """
    SELECT p_partkey, 'contains' AS link FROM part sub WHERE EXISTS (
      SELECT 1 FROM part main WHERE main.p_size < 5 AND contains(lower(sub.p_name), lower(main.p_type)))
    UNION ALL
    SELECT c_custkey AS p_partkey, 'ends' AS link FROM customer sub WHERE EXISTS (
      SELECT 1 FROM nation main WHERE ends_with(lower(sub.c_name), lower(CAST(main.n_nationkey AS VARCHAR))))
    UNION ALL
    SELECT p_partkey, 'starts' AS link FROM part sub WHERE EXISTS (
      SELECT 1 FROM (SELECT split_part(p_name, ' ', 1) AS word, p_size FROM part) main
      WHERE main.p_size < 2 AND starts_with(lower(sub.p_name), lower(main.word)))
    """,
)
def exists_text_links(spark, folder):
    part, customer, nation = (table(spark, folder, n) for n in ("part", "customer", "nation"))
    small = where(part, leaf("p_size", "<", 5))
    words = where(part, leaf("p_size", "<", 2)).select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"))
    first = exists(part, small, tree=both(_link("p_name", "contains", "p_type")))
    second = exists(customer, nation, tree=both(_link("c_name", "ends_with", "n_nationkey")))
    third = exists(part, words, tree=both(_link("p_name", "starts_with", "word")))
    return (
        first.select("p_partkey", F.lit("contains").alias("link"))
        .unionAll(second.select(F.col("c_custkey").alias("p_partkey"), F.lit("ends").alias("link")))
        .unionAll(third.select("p_partkey", F.lit("starts").alias("link")))
    )


@query(
    "exists_two_ranges",
    """
    WITH steps AS (SELECT c_nationkey, c_acctbal, max(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS most FROM customer),
         found AS (SELECT s_suppkey, s_nationkey, s_acctbal, (SELECT max(most) FROM steps WHERE c_nationkey = s_nationkey AND c_acctbal < s_acctbal) AS most FROM supplier)
    SELECT s_suppkey FROM found WHERE s_suppkey <= most
    """,
)
def exists_two_ranges(spark, folder):
    tree = both(_link("s_nationkey", "=", "c_nationkey"), _link("s_acctbal", ">", "c_acctbal"), _link("s_suppkey", "<=", "c_custkey"))
    return view(exists(table(spark, folder, "supplier"), table(spark, folder, "customer"), tree=tree), ["s_suppkey"])


@query(
    "exists_two_ranges_no_key",
    """
    WITH steps AS (SELECT DISTINCT o_totalprice, max(o_orderdate) OVER (ORDER BY o_totalprice DESC) AS latest FROM orders WHERE o_orderstatus = 'F')
    SELECT l_orderkey, l_linenumber FROM (SELECT * FROM lineitem WHERE l_quantity > 30) l
    ASOF JOIN steps s ON l.l_extendedprice * 5 <= s.o_totalprice WHERE l_shipdate < latest
    """,
)
def exists_two_ranges_no_key(spark, folder):
    lines = where(table(spark, folder, "lineitem"), leaf("l_quantity", ">", 30)).withColumn("five", F.col("l_extendedprice") * 5)
    finished = where(table(spark, folder, "orders"), leaf("o_orderstatus", "=", "F"))
    kept = exists(lines, finished, "sub.five <= main.o_totalprice AND sub.l_shipdate < main.o_orderdate")
    return view(kept, ["l_orderkey", "l_linenumber"])


@query(
    "exists_not_contains",
    """
    SELECT doc_id FROM documents sub WHERE text IS NOT NULL AND EXISTS (
      SELECT 1 FROM nation main WHERE NOT contains(lower(sub.text), lower(substr(main.n_name, 1, 2))))
    """,
)
def exists_not_contains(spark, folder):
    nation = table(spark, folder, "nation").select(F.substring("n_name", 1, 2).alias("start"))
    return view(exists(table(spark, folder, "documents"), nation, tree=both(_link("text", "not_contains", "start"))), ["doc_id"])


@query(
    "text_needles_indexed",
    """
    WITH needles AS (SELECT DISTINCT lower(substr(text, 40, 30)) AS needle FROM documents WHERE length(text) > 100),
         texts AS (SELECT doc_id, lower(text) AS t FROM documents)
    SELECT doc_id FROM texts WHERE EXISTS (SELECT 1 FROM needles WHERE contains(substr(t, 80), needle))
    """,
)
def text_needles_indexed(spark, folder):
    """Documents that repeat, later on, some document's passage: more needles than may be broadcast."""
    documents = table(spark, folder, "documents")
    needles = documents.where(F.length("text") > 100).select(F.substring("text", 40, 30).alias("needle"))
    texts = documents.select("doc_id", F.substring("text", 80, 2**30).alias("value"))
    found = text_matches(texts.select("value").distinct(), needles, "contains", broadcast_bytes=0)
    # The texts themselves need not be moved to meet again. No null, or Spark would filter the found ones by it and make the distinct texts twice.
    digest = F.coalesce(F.sha2("value", 256), F.lit("")).alias("digest")
    return texts.select("doc_id", digest).join(found.select(digest), "digest", "left_semi").select("doc_id")


@query(
    "exists_other_links",
    """
    SELECT c_custkey, 'not' AS link FROM customer sub WHERE EXISTS (SELECT 1 FROM supplier main WHERE main.s_suppkey < 3 AND sub.c_nationkey <> main.s_nationkey)
    UNION ALL
    SELECT c_custkey, 'least' AS link FROM customer sub WHERE EXISTS (SELECT 1 FROM supplier main WHERE sub.c_acctbal <= main.s_acctbal AND main.s_suppkey < 5)
    UNION ALL
    SELECT c_custkey, 'null' AS link FROM (SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg FROM customer) WHERE seg IS NULL
    UNION ALL
    SELECT c_custkey, 'empty' AS link FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_name END AS name FROM customer) WHERE name IS NULL OR name = ''
    """,
)
def exists_other_links(spark, folder):
    customer, supplier = table(spark, folder, "customer"), table(spark, folder, "supplier")
    segments = customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    names = customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.col("c_name")).alias("name"))
    found = [
        ("not", exists(customer, supplier.where("s_suppkey < 3"), tree=both(_link("c_nationkey", "!=", "s_nationkey")))),
        ("least", exists(customer, supplier.where("s_suppkey < 5"), tree=both(_link("c_acctbal", "<=", "s_acctbal")))),
        ("null", exists(segments, supplier, tree=both(_link("seg", "is_null"), _link("", "always_true")))),
        ("empty", exists(names, supplier, tree=both(_link("name", "is_empty"), either(_link("", "always_false"), _link("", "always_true"))))),
    ]
    out = [rows.select("c_custkey", F.lit(link).alias("link")) for link, rows in found]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


@query("exists_no_condition", "SELECT r_regionkey, r_name FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000)")
def exists_no_condition(spark, folder):
    return exists(table(spark, folder, "region"), where(table(spark, folder, "orders"), leaf("o_totalprice", ">", 1000)))


@query(
    "nested_detail",
    """
    SELECT o_orderkey, count(l_orderkey) AS match_count, 0 AS part,
           coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ' '
                               ORDER BY l_linenumber, l_quantity), '') AS detail_text
    FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 25) ON o_orderkey = l_orderkey
    GROUP BY o_orderkey
    """,
)
def nested_detail_query(spark, folder):
    lines = where(table(spark, folder, "lineitem"), leaf("l_quantity", ">", 25))
    lines = transform(
        view(lines, ["l_orderkey", "l_linenumber", "l_quantity"]),
        [{"outputField": "l_quantity", "expression": "int(l_quantity)"}],
    )
    orders = view(table(spark, folder, "orders"), ["o_orderkey"])
    nested = nested_detail(orders, lines, ["o_orderkey"], "main.o_orderkey = sub.l_orderkey", rows_per_part=10_000)
    piece = F.transform("details", lambda d: F.concat_ws(":", d["l_linenumber"], d["l_quantity"]))
    return nested.select("o_orderkey", "match_count", F.col("part").cast("int").alias("part"), F.array_join(piece, " ").alias("detail_text"))


@query(
    "nested_detail_parts",
    """
    WITH counts AS (SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_orderkey), 0)::BIGINT AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT c_custkey, n AS match_count, n AS dealt, keys, true AS few_parts, greatest(1, ceil(n / 4.0))::BIGINT AS most_parts FROM counts
    """,
)
def nested_detail_parts(spark, folder):
    """Details in parts of about four: every one is in some part, and there are no more parts than allowed."""
    orders = view(table(spark, folder, "orders"), ["o_orderkey", "o_custkey"])
    nested = nested_detail(view(table(spark, folder, "customer"), ["c_custkey"]), orders, ["c_custkey"], "main.c_custkey = sub.o_custkey", rows_per_part=4)
    parts = nested.groupBy("c_custkey", "match_count").agg(
        F.sum(F.size("details")).alias("dealt"),
        F.sum(F.aggregate("details", F.lit(0).cast("long"), lambda x, d: x + d["o_orderkey"])).alias("keys"),
        (F.max("part") < F.greatest(F.lit(1), F.ceil(F.col("match_count") / 4))).alias("few_parts"),
    )
    return parts.withColumn("most_parts", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("match_count") / 4)))


@query(
    "detail_match_counts",
    """
    SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS match_count
    FROM customer
    """,
)
def detail_match_counts(spark, folder):
    orders = where(table(spark, folder, "orders"), leaf("o_totalprice", ">", 200000))
    counted = match_counts(table(spark, folder, "customer"), orders, tree=both(_link("o_custkey", "=", "c_custkey")))
    return view(counted, ["c_custkey", "c_name", "match_count"])


@query(
    "detail_pairs",
    """
    SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 200000
    """,
)
def detail_pairs(spark, folder):
    orders = where(table(spark, folder, "orders"), leaf("o_totalprice", ">", 200000))
    pairs = detail_rows(table(spark, folder, "customer"), orders, "sub.o_custkey = main.c_custkey")
    return pairs.select("c_custkey", "detail.o_orderkey", "detail.o_totalprice")
