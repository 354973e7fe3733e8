"""Texts that match one of many needles, by marks of the needles' pieces, against loops over all pairs."""

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest

from tributary.operators import text_match
from tributary.operators.text_match import lacking, text_matches

TESTS = {"contains": str.__contains__, "starts_with": str.startswith, "ends_with": str.endswith}


def drawn(count, longest, seed, letters="abÄß x"):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(count)})


@pytest.mark.parametrize("op", sorted(TESTS))
def test_needles_of_all_lengths(spark, op):
    texts = [*drawn(120, 60, 1), "", "a"]
    needles = [x for x in drawn(90, 9, 2) if x] + [t[3:40] for t in texts[::9] if len(t) > 12] + [texts[5], texts[50][-7:], texts[51][:5], "no such piece at all"]
    df = spark.createDataFrame([(t,) for t in sorted(set(texts))] + [(None,)], "value string")
    got = text_matches(df, spark.createDataFrame([(n,) for n in needles] + [(None,)], "needle string"), op, broadcast_bytes=0)
    want = sorted(t for t in set(texts) if any(TESTS[op](t.lower(), n.lower()) for n in needles))
    assert sorted(r.value for r in got.collect()) == want


@pytest.mark.parametrize("op", sorted(TESTS))
def test_few_marks_lose_nothing(spark, op, monkeypatch):
    monkeypatch.setattr(text_match, "MOST_MARKS", 6)
    texts, needles = drawn(60, 30, 3), [x for x in drawn(60, 6, 4) if x]
    got = text_matches(spark.createDataFrame([(t,) for t in texts], "value string"), spark.createDataFrame([(n,) for n in needles], "needle string"), op, broadcast_bytes=0)
    assert sorted(r.value for r in got.collect()) == sorted(t for t in texts if any(TESTS[op](t.lower(), n.lower()) for n in needles))


def test_empty_and_no_needles(spark):
    texts = spark.createDataFrame([("one",), ("",)], "value string")
    none = spark.createDataFrame([], "needle string")
    assert text_matches(texts, none, "contains", broadcast_bytes=0).count() == 0
    assert text_matches(texts, spark.createDataFrame([("",)], "needle string"), "contains", broadcast_bytes=0).count() == 2
    assert lacking(texts, none).count() == 0


def test_only_pieces_that_may_be_needles_leave_their_task(spark):
    """All other pieces, as many as there are bytes in all texts, were sent as well."""
    needles = spark.createDataFrame([(f"needle {i:06d} of thirty letters",) for i in range(2000)], "needle string")
    anchored = needles.mapInArrow(text_match._anchors("contains"), "needle string, size int, anchor long, hash long")
    shared = SimpleNamespace(value=text_match._marks(anchored))
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(20_000)) for _ in range(10)] + ["see needle 000017 of thirty letters, needle 000017 and needle 9"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["key", "folded"])
    rows = [r for b in text_match._pieces("contains", shared)([batch]) for r in b.to_pylist()]
    assert [r["key"] for r in rows].count(10) == 1 and len(rows) < 1000
