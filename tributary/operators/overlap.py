"""Branch overlap: how many distinct whole rows each pair of branches shares."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.names import col

BITS = 60
REPORT = "branch_a string, branch_b string, shared_rows long"


def overlap(spark: SparkSession, branches: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``(branch_a, branch_b, shared_rows)`` for every pair, 0 when nothing is shared.

    Columns are matched by position; branches whose column types differ share nothing. All branches
    are tagged and grouped by the whole row once; then rows are counted per set of branches, and
    only that small table is unfolded into pairs. Fewer than two branches give an empty report.
    """
    names = [n for n, _ in branches]
    pairs = list(itertools.combinations(range(len(branches)), 2))
    if not pairs:
        return spark.createDataFrame([], REPORT)
    alike: dict[tuple, list[int]] = {}
    for i, (_, df) in enumerate(branches):
        alike.setdefault(tuple(f.dataType.simpleString() for f in df.schema), []).append(i)
    counts = None
    for members in (m for m in alike.values() if len(m) > 1):
        part = _shared(branches, members)
        counts = part if counts is None else counts.unionByName(part)
    report = spark.createDataFrame([(a, b, names[a], names[b]) for a, b in pairs], "a int, b int, branch_a string, branch_b string")
    if counts is None:
        return report.select("branch_a", "branch_b", F.lit(0).cast("long").alias("shared_rows"))
    joined = report.join(counts, ["a", "b"], "left")
    return joined.select("branch_a", "branch_b", F.coalesce("shared_rows", F.lit(0)).alias("shared_rows"))


def _shared(branches: Sequence[tuple[str, DataFrame]], members: Sequence[int]) -> DataFrame:
    width = len(branches[members[0]][1].columns)
    fields = [f"c{i}" for i in range(width)]
    # Which branches have a row is kept as bits, so that the large aggregation stays a hash aggregation.
    words = [f"w{i}" for i in range(max(members) // BITS + 1)]
    tagged = None
    for i in members:
        df = branches[i][1]
        cells = [_comparable(col(f.name), f.dataType).alias(n) for f, n in zip(df.schema, fields)]
        marks = [F.lit(1 << i % BITS if w == i // BITS else 0).cast("long").alias(n) for w, n in enumerate(words)]
        part = df.select(*cells, *marks)
        tagged = part if tagged is None else tagged.union(part)
    sets = tagged.groupBy(*fields).agg(*[F.bit_or(w).alias(w) for w in words])
    sets = sets.groupBy(*words).agg(F.count(F.lit(1)).alias("n"))
    owns = [F.when(F.getbit(words[i // BITS], F.lit(i % BITS)) == 1, F.lit(i)) for i in members]
    owners = sets.select("n", F.array_compact(F.array(*owns)).alias("owners"))
    unfolded = owners.select("n", "owners", F.explode("owners").alias("a")).select("n", "a", F.explode("owners").alias("b"))
    return unfolded.where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.sum("n").alias("shared_rows"))


def _comparable(c: Column, data_type: T.DataType) -> Column:
    return F.sort_array(F.map_entries(c)) if isinstance(data_type, T.MapType) else c
