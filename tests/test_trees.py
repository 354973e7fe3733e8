"""Step trees: order, switches, sources, variables, sub-views, reports, import."""

import json

import pytest

from tributary import Plan, StepError, UserFunction, Workspace, read_tree, read_tree_file, set_enabled
from tributary.examples.trees import shop_tree

PEOPLE = [(1, "Ann", 10, 30.0), (2, "Bo", 10, 20.0), (3, "Cy", 20, 50.0), (4, None, None, 5.0)]
TEAMS = [(10, "red"), (20, "blue"), (30, "green")]


@pytest.fixture
def tables(spark):
    ws = Workspace(spark)
    ws.attach("people", spark.createDataFrame(PEOPLE, "id long, name string, team long, pay double"))
    ws.attach("teams", spark.createDataFrame(TEAMS, "team long, colour string"))
    return ws


def cmd(id_, type_, order=0, **config):
    return {"id": id_, "type": type_, "order": order, "config": config}


def node(id_, *commands, children=(), **more):
    return {"id": id_, "type": "operation", "name": id_, "enabled": True, "commands": list(commands), "children": list(children), **more}


SOURCES = node(
    "setup",
    cmd("s1", "source", 1, mainTable="teams", linkId="L_teams", alias="t"),
    cmd("s2", "source", 2, mainTable="people", linkId="L_people", alias="p"),
)


def plan(tables, *children, commands=(), **options):
    root = node("root", *SOURCES["commands"], *commands, children=children, operationType="root")
    return Plan(read_tree(root), tables, **options)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_commands_run_by_order_and_stop(tables):
    steps = node("n", cmd("late", "filter", 2, field="pay", operator=">", value=25), cmd("early", "transform", 1, mappings=[{"outputField": "pay", "expression": "pay + 10"}]))
    p = plan(tables, steps)
    assert rows(p.result("n").select("id")) == [(1,), (2,), (3,)]
    assert rows(p.result("n", stop_at="early").select("id")) == [(1,), (2,), (3,), (4,)]
    with pytest.raises(StepError):
        p.result("nowhere")


def test_disabled_nodes_pass_through(tables):
    inner = node("inner", cmd("f2", "filter", field="pay", operator="<", value=40))
    outer = node("outer", cmd("f1", "filter", field="team", operator="=", value=10), children=[inner])
    p = plan(tables, outer)
    assert p.result("inner").count() == 2
    assert Plan(set_enabled(p.tree, "outer", False), tables).result("inner").count() == 3
    off = set_enabled(p.tree, "outer", False, cascade=True)
    assert Plan(off, tables).result("inner").count() == 4
    on = set_enabled(off, "outer", True, cascade=True)
    assert not on.path("inner")[-1].enabled and on.path("outer")[-1].enabled


def test_source_override(tables):
    n = node(
        "n",
        cmd("a", "filter", 1, dataSource="L_people", field="pay", operator=">", value=10),
        cmd("b", "filter", 2, dataSource="people", field="pay", operator="<", value=40),
        cmd("c", "filter", 3, dataSource="p", field="team", operator="is_not_null"),
    )
    assert plan(tables, n).result("n").count() == 2
    n["commands"].append(cmd("d", "view", 4, dataSource="teams"))
    assert plan(tables, n).result("n").columns == ["team", "colour"]
    back = node("m", cmd("e", "filter", 1, dataSource="people", field="pay", operator=">", value=0))
    assert plan(tables, node("n2", *n["commands"], children=[back])).result("m").count() == 4


def test_reload_after_group(tables):
    n = node(
        "n",
        cmd("g", "group", 1, dataSource="people", groupByFields=["team"], aggregations=[{"field": "pay", "func": "sum", "alias": "total"}], outputTableName="pay by team"),
        cmd("f", "filter", 2, dataSource="people", field="pay", operator=">", value=25),
    )
    p = plan(tables, n)
    assert p.result("n").columns == ["id", "name", "team", "pay"] and p.result("n").count() == 2
    assert rows(p.workspace.table("pay by team")) == [(10, 50.0), (20, 50.0)]
    assert rows(p.workspace.sql("SELECT sum(total) FROM `pay by team`")) == [(100.0,)]
    n["commands"][1]["config"] = {"field": "total", "operator": ">", "value": 60}
    assert plan(tables, n).result("n").count() == 0


def test_group_keeps_key_order_for_a_limit(tables):
    n = node("n", cmd("g", "aggregate", 1, groupBy=["team"], field="pay", aggFunc="mean"), cmd("v", "view", 2, viewLimit=1))
    assert rows(plan(tables, n).result("n")) == [(10, 25.0)]


def test_first_last_use_the_last_sort(tables):
    g = cmd("g", "group", 2, groupByFields=["team"], aggregations=[{"field": "name", "func": "first", "alias": "top"}])
    assert rows(plan(tables, node("n", cmd("s", "sort", 1, field="pay", ascending=False), g)).result("n")) == [(10, "Ann"), (20, "Cy")]
    with pytest.raises(StepError, match="order_by"):
        plan(tables, node("n", g)).result("n")


def test_joins(tables):
    def joined(**config):
        return plan(tables, node("other", cmd("o", "filter", 1, dataSource="t", field="colour", operator="=", value="red")), node("n", cmd("j", "join", 1, dataSource="people", **config))).result("n")

    left = joined(joinTable="L_teams", joinType="LEFT", on="p.team = t.team")
    assert left.columns == ["id", "name", "team", "pay", "colour"] and left.count() == 4
    assert joined(joinTable="teams", joinType="FULL", on="team = team").count() == 5
    assert joined(joinTargetType="node", joinTargetNodeId="other", joinType="INNER", on="team").count() == 2
    assert joined(joinTable="people", joinType="INNER", on="people.pay > p.pay").count() == 6
    with pytest.raises(StepError, match="itself"):
        joined(joinTargetType="node", joinTargetNodeId="n", on="team")
    with pytest.raises(StepError, match="command j"):
        joined(on="team")


def test_variables_flow_down_the_path(tables):
    save = cmd("v", "save", 2, field="team", value="rich_teams")
    top = node("top", cmd("f", "filter", 1, field="pay", operator=">", value=40), save)
    use = node("use", cmd("w", "filter", 1, dataSource="teams", field="team", operator="in_variable", value="rich_teams"))
    list_use = node("list_use", cmd("w", "filter", 1, dataSource="teams", field="colour", operator="in_list", value="{wanted}"))
    define = cmd("d", "define_variable", 9, variableName="wanted", variableType="list", variableValue=["red", "green"])
    p = plan(tables, {**top, "children": [use, list_use]}, commands=[define])
    assert rows(p.result("use")) == [(20, "blue")]
    assert rows(p.result("list_use")) == [(10, "red"), (30, "green")]


def test_sub_views(tables):
    sub = {"id": "teams_of", "table": "L_teams", "on": "main.team = sub.team", "label": "x"}
    tree = {"id": "all_teams", "table": "t", "on": "", "label": "y", "conditionGroup": {"logicalOperator": "OR", "conditions": [{"field": "team", "operator": ">", "mainField": "pay"}, {"field": "sub.colour", "operator": "contains", "mainField": "main.name"}]}}
    n = node("n", cmd("f", "filter", 1, dataSource="people", field="pay", operator=">", value=25), cmd("m", "multi_table", 2, subTables=[sub, tree]), cmd("z", "filter", 3, field="id", operator="=", value=-1))
    p = plan(tables, n)
    assert p.result("n").count() == 0
    assert rows(p.result("n", view_id="teams_of")) == [(10, "red"), (20, "blue")]
    assert rows(p.result("n", view_id="all_teams")) == []
    with pytest.raises(StepError):
        p.result("n", view_id="none")
    n["commands"][0]["config"]["value"] = 1000
    assert plan(tables, n).result("n", view_id="teams_of").columns == ["team", "colour"]


def test_counts_and_overlap(spark, tables):
    a = node("a", cmd("f", "filter", field="pay", operator=">", value=10))
    b = node("b", cmd("f", "filter", field="team", operator="=", value=10))
    c = node("c", cmd("f", "filter", field="id", operator="=", value=4))
    off = {**node("off"), "enabled": False}
    p = plan(tables, node("base", cmd("f0", "filter", dataSource="people", field="id", operator="<", value=9), children=[a, b, c, off]))
    assert [tuple(r) for r in p.step_counts("a").orderBy("step").collect()] == [(1, "root", 4), (2, "base", 4), (3, "a", 3)]
    for persist in (False, True):
        assert rows(p.overlap("base", persist)) == [("a", "b", 2), ("a", "c", 0), ("b", "c", 0)]
    with p:
        before = spark.sparkContext._jsc.getPersistentRDDs().size()
        assert before
    assert spark.sparkContext._jsc.getPersistentRDDs().size() < before
    assert p.overlap("a").collect() == []


def test_python_functions_are_registered_not_run_from_text(tables):
    n = node("n", cmd("t", "transform", 1, mappings=[{"mode": "python", "expression": "def transform(row): return 1", "outputField": "twice"}]))
    with pytest.raises(StepError, match="registered"):
        plan(tables, n).result("n")
    twice = UserFunction(lambda row: row["pay"] * 2, "double", ["pay"])
    assert plan(tables, n, functions={"twice": twice}).result("n").selectExpr("sum(twice)").first()[0] == 210.0


def test_errors_name_the_step(tables):
    n = node("prices", cmd("bad", "filter", 1, field="prize", operator=">", value=1))
    with pytest.raises(StepError, match=r"step 'prices', command bad \(filter\)"):
        plan(tables, n).result("prices")
    assert plan(tables, n, on_missing="pass").result("prices").count() == 4
    with pytest.raises(StepError, match="unknown command"):
        plan(tables, node("n", cmd("x", "pivot"))).result("n")
    with pytest.raises(StepError, match="unknown table"):
        plan(tables, node("n", cmd("x", "view", dataSource="nothing"))).result("n")


def test_null_safe_joins(tables):
    n = node("n", cmd("j", "join", 1, joinTable="people", joinType="INNER", on="team = team", joinSuffix="_2"))
    assert plan(tables, n).result("n").count() == 5
    assert plan(tables, n, null_safe_joins=True).result("n").count() == 6


def test_reading_trees(tmp_path):
    tree = read_tree(json.dumps(shop_tree()))
    assert tree.kind == "root" and [n.id for n in tree.path("by_customer")] == ["root", "setup", "recent", "finished", "by_customer"]
    raw = {"id": "a", "name": "A", "type": "operation", "commands": [{"config": {"field": "x"}}, {"id": "c", "type": "sort", "order": "7"}, {}], "children": None}
    wrapped = read_tree(raw)
    assert wrapped.kind == "root" and wrapped.children[0].kind == "process"
    commands = wrapped.children[0].commands
    assert [(c.type, c.order) for c in commands] == [("filter", 1), ("sort", 7.0), ("filter", 3)] and commands[0].id
    assert len(read_tree([raw, {**raw, "id": "b"}]).children) == 2
    assert len(read_tree({"operations": [raw]}).children) == 1
    with pytest.raises(ValueError):
        read_tree({"something": "else"})
    path = tmp_path / "tree.json"
    path.write_text(json.dumps({"tree": raw}))
    assert read_tree_file(str(path)) == wrapped


@pytest.mark.parametrize(
    ("child", "says"),
    [
        ({"id": "a", "children": []}, "without name"),
        ({"id": "a"}, "without name"),
        ({"name": "b"}, "without id"),
        ({"id": "a", "name": " "}, "without name"),
        ({"id": "a", "name": "b", "type": "note", "children": [{"id": "c", "name": "d"}]}, "unknown type 'note'"),
        ({"id": "a", "name": "b", "commands": {"type": "filter"}}, "'commands' is no list"),
        ({"id": "a", "name": "b", "commands": [5]}, "not a command"),
        (3, "not a step"),
    ],
)
def test_what_is_no_step_is_refused(child, says):
    for tree in ({"id": "r", "name": "all", "operationType": "root", "children": [child]}, [child], {"operations": [child]}):
        with pytest.raises(ValueError, match=says):
            read_tree(tree)


def test_an_output_table_is_written_once(spark, tmp_path):
    tables = Workspace(spark, str(tmp_path))
    tables.save("t", spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "k long, v long"))
    grouped = node("g", cmd("c", "group", 1, dataSource="t", groupByFields=["k"], aggregations=[{"func": "sum", "field": "v", "alias": "total"}], outputTableName="totals"))
    shown = Plan(read_tree(grouped), tables)
    writes = []
    save, tables.save = tables.save, lambda *a: writes.append(a[0]) or save(*a)
    for _ in range(2):
        assert sorted(map(tuple, shown.result("g").collect())) == [(1, 5), (2, 4)]
    shown.step_counts("g").collect()
    assert writes == ["totals"]
    save("t", spark.createDataFrame([(7, 7)], "k long, v long"))
    assert [tuple(r) for r in shown.result("g").collect()] == [(7, 7)] == [tuple(r) for r in tables.table("totals").collect()]
    assert writes == ["totals"] * 2
    save("totals", spark.createDataFrame([(0, 0)], "k long, total long"))
    assert [tuple(r) for r in shown.result("g").collect()] == [(7, 7)]


def test_step_counts_of_a_filter_path_take_one_scan(spark, tables):
    """Counts of nodes that only filter or derive come from one job; what the optimiser leaves out is counted all the same."""
    scanned = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            scanned.add(batch.num_rows)
            yield batch

    people = spark.createDataFrame(PEOPLE, "id long, name string, team long, pay double").repartition(1).mapInArrow(seen, "id long, name string, team long, pay double")
    tables.attach("people", people)
    never = node("never", cmd("f3", "filter", field="id", operator="always_false", value=""))
    paid = node("paid", cmd("f2", "filter", field="twice", operator=">", value=35), children=[never])
    twice = node("twice", cmd("t", "transform", mappings=[{"outputField": "twice", "expression": "2 * pay", "mode": "simple", "id": "m"}]), children=[paid])
    grouped = node("teams", cmd("g", "group", groupByFields=["team"], aggregations=[{"func": "count", "field": "*", "alias": "n"}]))
    more = node("more", cmd("f4", "filter", field="n", operator=">", value=1))
    p = plan(tables, node("base", cmd("f0", "filter", dataSource="people", field="id", operator="<", value=4), children=[twice, {**grouped, "children": [more]}]))
    assert [tuple(r) for r in p.step_counts("paid").orderBy("step").collect()] == [(1, "root", 4), (2, "base", 3), (3, "twice", 3), (4, "paid", 3)]
    assert scanned.value == len(PEOPLE)
    assert [r.row_count for r in p.step_counts("never").orderBy("step").collect()] == [4, 3, 3, 3, 0]
    assert [tuple(r) for r in p.step_counts("more").orderBy("step").collect()] == [(1, "root", 4), (2, "base", 3), (3, "teams", 2), (4, "more", 1)]
