"""EXISTS sub-views and detail rows against brute force over random link trees."""

import random

import pytest

from tributary import detail_rows, exists, match_counts, nested_detail
from tributary.functions import links

SUB = "id long, a long, s string, t string"
MAIN = "x long, m string, y long"
WORDS = ["tea", "TEAPOT", "pot", "a", "", "rice", "ice", "x%", "%", None]


def tables(seed):
    rng = random.Random(seed)
    some = lambda: rng.choice([None, *range(6)])
    subs = [(i, some(), rng.choice(WORDS), rng.choice(WORDS)) for i in range(30)]
    mains = [(some(), rng.choice(WORDS), some()) for _ in range(rng.choice([0, 1, 3, 6]))]
    return subs, mains


def link_value(op, s, m):
    if op in ("contains", "not_contains", "starts_with", "ends_with"):
        if s is None or m is None:
            return False
        s, m = str(s).lower(), str(m).lower()
        return {"contains": m in s, "not_contains": m not in s, "starts_with": s.startswith(m), "ends_with": s.endswith(m)}[op]
    if s is None or m is None:
        return False
    return {"=": s == m, "!=": s != m, ">": s > m, ">=": s >= m, "<": s < m, "<=": s <= m}[op]


def holds(tree, sub, main):
    if "conditions" in tree:
        results = [holds(c, sub, main) for c in tree["conditions"]]
        return True if not results else (all if tree["logicalOperator"] == "AND" else any)(results)
    op = tree["operator"]
    if op.startswith("always"):
        return op == "always_true"
    s = sub[["id", "a", "s", "t"].index(tree["field"])]
    if op.startswith("is_"):
        return {"is_null": s is None, "is_not_null": s is not None, "is_empty": s in (None, ""), "is_not_empty": s not in (None, "")}[op]
    return link_value(op, s, main[["x", "m", "y"].index(tree["mainField"])])


def random_tree(rng, depth=0):
    conditions = []
    for _ in range(rng.choice([1, 2, 2, 3])):
        if depth < 2 and rng.random() < 0.3:
            conditions.append({"type": "group", **random_tree(rng, depth + 1)})
            continue
        r = rng.random()
        if r < 0.15:
            conditions.append({"operator": rng.choice(["is_null", "is_not_null", "is_empty", "is_not_empty"]), "field": rng.choice(["a", "s"])})
        elif r < 0.2:
            conditions.append({"operator": rng.choice(["always_true", "always_false"])})
        elif r < 0.6:
            conditions.append({"operator": rng.choice(["=", "!=", ">", ">=", "<", "<="]), "field": "a", "mainField": rng.choice(["x", "y"])})
        elif r < 0.7:
            conditions.append({"operator": "=", "field": rng.choice(["s", "t"]), "mainField": "m"})
        else:
            op = rng.choice(["contains", "not_contains", "starts_with", "ends_with"])
            conditions.append({"operator": op, "field": rng.choice(["s", "t"]), "mainField": "m"})
    return {"logicalOperator": rng.choice(["AND", "OR"]), "conditions": conditions}


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
@pytest.mark.parametrize("seed", range(12))
def test_random_trees(spark, seed, broadcast):
    rng = random.Random(100 + seed)
    subs, mains = tables(seed)
    sdf, mdf = spark.createDataFrame(subs, SUB), spark.createDataFrame(mains, MAIN)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        for _ in range(2):
            tree = random_tree(rng)
            want = [s[0] for s in subs if any(holds(tree, s, m) for m in mains)]
            assert sorted(r.id for r in exists(sdf, mdf, tree=tree).collect()) == want, tree
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def leaf(field, op, main_field):
    return {"field": field, "operator": op, "mainField": main_field}


def test_on_text(spark):
    subs, mains = tables(5)
    mains = [(1, "tea", 2), (3, "pot", 5), (None, "x", 1)]
    sdf, mdf = spark.createDataFrame(subs, SUB), spark.createDataFrame(mains, MAIN)

    def ids(on, **more):
        return sorted(r.id for r in exists(sdf, mdf, on, **more).collect())

    equal = [s[0] for s in subs if s[1] in (1, 3)]
    assert ids("main.x = sub.a") == ids("sub.a = main.x") == ids("shop.x = item.a", sub_names=["item"], main_names=["shop"]) == equal
    assert ids("x = a") == equal
    assert ids("sub.a > main.x AND main.y = 5") == [s[0] for s in subs if s[1] is not None and s[1] > 3]
    assert ids("1=1") == ids("") == [s[0] for s in subs]
    assert ids("main.x = sub.a", tree={"conditions": [leaf("s", "contains", "m")]}) == [
        s[0] for s in subs if any(s[1] == m[0] and link_value("contains", s[2], m[1]) for m in mains)
    ]
    with pytest.raises(ValueError):
        ids("elsewhere.x = sub.a")
    with pytest.raises(ValueError):
        ids("main.nothing = sub.a")


def test_link_text_is_literal_and_ignores_case(spark):
    sdf = spark.createDataFrame([(1, 0, "10% off", ""), (2, 0, "100 off", ""), (3, 0, "Rice", "")], SUB)
    mdf = spark.createDataFrame([(0, "0% O", 0), (0, "rIC", 0)], MAIN)
    assert [r.id for r in exists(sdf, mdf, tree={"conditions": [leaf("s", "contains", "m")]}).orderBy("id").collect()] == [1, 3]


def test_requalify_leaves_quoted_text():
    text = "o.a = 'o.a' AND x.o.b > \"o\".c AND no.d = 1"
    assert links.requalify(text, {"o": "main"}) == "main.a = 'o.a' AND x.o.b > main.c AND no.d = 1"


def test_detail(spark, monkeypatch):
    from tributary.operators import skew

    mains = [(1, "one", 0), (2, "two", 0), (3, "three", 0)]
    subs = [(i, 1 if i < 20 else 2, "s", None) for i in range(25)] + [(99, 1, "s", None)] * 3
    mdf, sdf = spark.createDataFrame(mains, MAIN), spark.createDataFrame(subs, SUB)
    counts = {r.x: r.match_count for r in match_counts(mdf, sdf, "main.x = sub.a").collect()}
    assert counts == {1: 23, 2: 5, 3: 0}
    assert detail_rows(mdf, sdf, "main.x = sub.a").count() == 28
    for threshold in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        monkeypatch.setattr(skew, "ROWS_PER_SHARD", 10)
        rows = nested_detail(mdf, sdf, ["x"], "main.x = sub.a", rows_per_part=6).collect()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert {r.x: r.match_count for r in rows} == counts
        assert len({(r.x, r.part) for r in rows}) == len(rows) and len([r for r in rows if r.x == 1]) > 1
        assert sorted((r.x, d.id) for r in rows for d in r.details) == sorted((s[1], s[0]) for s in subs)
        assert [(r.part, r.m, r.details) for r in rows if r.x == 3] == [(0, "three", [])]
        again = nested_detail(mdf, sdf.repartition(7), ["x"], "main.x = sub.a", rows_per_part=6).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, rows))
    with pytest.raises(ValueError):
        match_counts(mdf, sdf, "main.x > sub.a")
    above = nested_detail(mdf, sdf, ["x"], "main.x > sub.a AND main.x != 3", rows_per_part=100).collect()
    assert sorted((r.x, r.match_count, len(r.details)) for r in above) == [(1, 0, 0), (2, 23, 23), (3, 0, 0)]
