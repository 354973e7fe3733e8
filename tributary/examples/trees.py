"""Step trees: the same tree run to several nodes and in several states."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary import Plan, Workspace, read_tree, set_enabled
from tributary.examples.registry import both, either, leaf, query, table

TABLES = ("orders", "customer", "lineitem")


def _command(id_, type_, order, **config):
    return {"id": id_, "type": type_, "order": order, "config": config}


def _node(id_, *commands, children=(), kind="process", enabled=True):
    return {
        "id": id_, "type": "operation", "operationType": kind, "name": id_, "enabled": enabled,
        "commands": list(commands), "children": list(children),
    }


def shop_tree() -> dict:
    """Sources, a shared filter, and branches that group, join, capture and compare."""
    setup = _node(
        "setup",
        _command("src_orders", "source", 1, mainTable="orders", alias="o", linkId="link_orders"),
        _command("src_customer", "source", 2, mainTable="customer", alias="c", linkId="link_customer"),
        _command("limit_var", "define_variable", 3, variableName="least", variableType="text", variableValue="150000"),
        kind="setup",
        children=[
            _node(
                "recent",
                _command("pick", "filter", 1, dataSource="link_orders", filterRoot=both(leaf("o_totalprice", ">", "{least}", dataType="number"))),
                _command(
                    "slim", "view", 2, dataSource="stream",
                    viewFields=[{"field": f} for f in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")],
                ),
                children=[
                    _node(
                        "finished",
                        _command("f", "filter", 1, field="o_orderstatus", operator="=", value="F"),
                        children=[
                            _node(
                                "by_customer",
                                _command(
                                    "g", "group", 1, groupByFields=["o_custkey"],
                                    aggregations=[{"field": "*", "func": "count", "alias": "orders"}, {"field": "o_totalprice", "func": "max", "alias": "largest"}],
                                    havingConditions=[{"metricAlias": "orders", "operator": ">=", "value": 2}],
                                ),
                                _command("j", "join", 2, joinTargetType="table", joinTable="link_customer", joinType="LEFT", on="o.o_custkey = c.c_custkey"),
                                _command("t", "transform", 3, mappings=[{"mode": "simple", "expression": "largest // 1000", "outputField": "thousands"}]),
                                _command("v", "view", 4, viewFields=[{"field": f} for f in ("o_custkey", "orders", "thousands", "c_name")]),
                            )
                        ],
                    ),
                    _node("huge", _command("h", "filter", 1, field="o_totalprice", operator=">", value=300000)),
                    _node("odd", _command("p", "filter", 1, field="o_orderstatus", operator="in_list", value="P,O")),
                ],
            ),
            _node(
                "names",
                _command("cap", "filter", 1, dataSource="c", filterRoot=both(leaf("c_acctbal", ">", 5000))),
                _command("keep", "save", 2, field="c_custkey", value="rich", distinct=True),
                _command("back", "filter", 3, dataSource="o", filterRoot=either(leaf("o_custkey", "in_variable", "rich"), leaf("o_orderstatus", "=", "P"))),
                _command("sub", "multi_table", 4, subTables=[{"id": "their_customers", "table": "link_customer", "on": "main.o_custkey = sub.c_custkey", "label": "customers"}]),
                _command("cut", "view", 5, viewFields=[{"field": "o_orderkey"}, {"field": "o_custkey"}]),
            ),
            _node(
                "averages",
                _command("avg", "group", 1, dataSource="orders", groupByFields=["o_orderstatus"], field="o_custkey", aggFunc="max", outputTableName="status_max"),
                _command("again", "filter", 2, dataSource="orders", field="o_totalprice", operator=">", value=450000),
                _command("cut2", "view", 3, viewFields=[{"field": "o_orderkey"}, {"field": "o_totalprice"}]),
            ),
            _node(
                "with_branch",
                _command("jn", "join", 1, dataSource="customer", joinTargetType="node", joinTargetNodeId="huge", joinType="INNER", on="c_custkey = o_custkey"),
                _command("cut3", "view", 2, viewFields=[{"field": f} for f in ("c_custkey", "c_name", "o_orderkey")]),
            ),
        ],
    )
    return {"version": 1, "tree": _node("root", kind="root", children=[setup])}


def _plan(spark, folder, edit=lambda tree: tree) -> Plan:
    tables = Workspace(spark)
    for name in TABLES:
        tables.attach(name, table(spark, folder, name))
    return Plan(edit(read_tree(shop_tree())), tables)


_RECENT = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 150000"


def _by_customer(source: str) -> str:
    return f"""
    SELECT o_custkey, orders, CAST(floor(largest / 1000) AS DOUBLE) AS thousands, c_name
    FROM (SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS largest FROM ({source}) GROUP BY o_custkey HAVING count(*) >= 2)
    LEFT JOIN customer ON o_custkey = c_custkey
    """


@query("tree_branch", _by_customer(_RECENT + " AND o_orderstatus = 'F'"))
def tree_branch(spark, folder):
    return _plan(spark, folder).result("by_customer")


@query("tree_disabled", _by_customer(_RECENT))
def tree_disabled(spark, folder):
    return _plan(spark, folder, lambda t: set_enabled(t, "finished", False)).result("by_customer")


@query("tree_cascade", _RECENT)
def tree_cascade(spark, folder):
    return _plan(spark, folder, lambda t: set_enabled(t, "finished", False, cascade=True)).result("by_customer")


@query(
    "tree_stop_at",
    f"SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS largest FROM ({_RECENT} AND o_orderstatus = 'F') GROUP BY o_custkey HAVING count(*) >= 2",
)
def tree_stop_at(spark, folder):
    return _plan(spark, folder).result("by_customer", stop_at="g")


_NAMES = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) OR o_orderstatus = 'P'"


@query("tree_source_override", _NAMES)
def tree_source_override(spark, folder):
    return _plan(spark, folder).result("names")


@query("tree_sub_view", f"SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM ({_NAMES}))")
def tree_sub_view(spark, folder):
    return _plan(spark, folder).result("names", view_id="their_customers")


@query("tree_reload_after_group", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 450000")
def tree_reload_after_group(spark, folder):
    return _plan(spark, folder).result("averages")


@query("tree_saved_table", "SELECT o_orderstatus, max(o_custkey) AS max_o_custkey FROM orders GROUP BY o_orderstatus")
def tree_saved_table(spark, folder):
    plan = _plan(spark, folder)
    plan.result("averages")
    return plan.workspace.table("status_max")


@query(
    "tree_join_branch",
    "SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000",
)
def tree_join_branch(spark, folder):
    return _plan(spark, folder).result("with_branch")


@query(
    "step_counts",
    f"""
    SELECT 1 AS step, 'setup' AS node_id, (SELECT count(*) FROM customer) AS row_count
    UNION ALL SELECT 2, 'recent', (SELECT count(*) FROM ({_RECENT}))
    UNION ALL SELECT 3, 'finished', (SELECT count(*) FROM ({_RECENT} AND o_orderstatus = 'F'))
    UNION ALL SELECT 4, 'by_customer', (SELECT count(*) FROM ({_by_customer(_RECENT + " AND o_orderstatus = 'F'")}))
    """,
)
def step_counts(spark, folder):
    return _plan(spark, folder).step_counts("by_customer")


@query(
    "tree_overlap",
    f"""
    SELECT 'finished' AS branch_a, 'huge' AS branch_b, count(*) AS shared_rows FROM ({_RECENT} AND o_orderstatus = 'F' AND o_totalprice > 300000)
    UNION ALL SELECT 'finished', 'odd', 0
    UNION ALL SELECT 'huge', 'odd', count(*) FROM ({_RECENT} AND o_orderstatus IN ('P', 'O') AND o_totalprice > 300000)
    """,
)
def tree_overlap(spark, folder):
    return _plan(spark, folder).overlap("recent")


@query(
    "tree_forms",
    """
    SELECT form, o_orderstatus, count(*) AS orders FROM orders, (SELECT unnest(['export', 'list', 'operations', 'single', 'root']) AS form)
    WHERE o_totalprice > 200000 GROUP BY ALL
    """,
)
def tree_forms(spark, folder):
    """One step read from each form a tree file may have; its commands have no ids."""
    step = {
        "id": "n", "name": "status", "type": "operation", "commands": [
            {"type": "filter", "config": {"dataSource": "orders", "field": "o_totalprice", "operator": ">", "value": 200000}},
            {"type": "group", "order": "7", "config": {"groupByFields": ["o_orderstatus"], "aggregations": [{"field": "*", "func": "count", "alias": "orders"}]}},
        ],
    }
    root = {"id": "r", "name": "all", "operationType": "root", "children": [step]}
    forms = {"export": {"version": 1, "tree": root}, "list": [step], "operations": {"operations": [step]}, "single": step, "root": root}
    tables = Workspace(spark)
    tables.attach("orders", table(spark, folder, "orders"))
    found = [Plan(read_tree(form), tables).result("n").select(F.lit(name).alias("form"), "o_orderstatus", "orders") for name, form in forms.items()]
    return reduce(DataFrame.unionAll, found)


@query("tree_saved_once", "SELECT o_orderstatus, max(o_custkey) AS max_o_custkey, 1::BIGINT AS versions FROM orders GROUP BY o_orderstatus")
def tree_saved_once(spark, folder):
    """Three results that have a step with an output table write it once."""
    plan = _plan(spark, folder)
    plan.result("averages")
    plan.step_counts("averages")
    plan.result("averages")
    files = spark.read.parquet(f"{plan.workspace.root}/status_max/*").select(F.regexp_extract(F.col("_metadata.file_path"), "([0-9a-f]{32})/[^/]*$", 1).alias("version"))
    versions = files.agg(F.count_distinct("version").alias("versions"))
    return plan.workspace.table("status_max").crossJoin(F.broadcast(versions))
