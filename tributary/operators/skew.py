"""Joins that survive hot keys.

Adaptive execution splits a hot key of an inner, semi or anti join, and of the preserved side of an
outer join. It cannot split the side an outer join pads with nulls: one task would get all rows of
the key. Here the hot keys of that side are spread over shards by the map task that read the row (the
same on every retry), and the few matching rows of the preserved side are copied once per shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.names import col
from tributary.functions.predicates import all_of

ROWS_PER_SHARD = 1_000_000
HOT_KEYS = 1024
Keys = Sequence[tuple[str, str]]


def key_test(keys: Keys, left: str, right: str, null_safe: bool) -> Column:
    pairs = [(col(a, left), col(b, right)) for a, b in keys]
    return all_of(a.eqNullSafe(b) if null_safe else a == b for a, b in pairs)


def left_outer(
    left: DataFrame, right: DataFrame, keys: Keys, null_safe: bool = False, rows_per_shard: int | None = None
) -> DataFrame:
    """``left LEFT JOIN right`` on equal keys, with columns qualified ``t1`` and ``t2``.

    Hot keys are the at most 1024 most frequent right keys with more than ``rows_per_shard`` rows,
    counted with map-side aggregation over the key columns alone; that bound makes their
    broadcast safe. Any other key holds less than a thousandth of the rows and needs no help. Both
    sides must see the same hot keys, so ties are settled by the key itself; which keys are hot
    does not change the result.
    """
    rows_per_shard = rows_per_shard or ROWS_PER_SHARD
    right_keys = [b for _, b in keys]
    hot = (
        right.groupBy(*[col(b).alias(f"__k{i}") for i, b in enumerate(right_keys)])
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > rows_per_shard)
        .orderBy(F.desc("__n"), *[f"__k{i}" for i in range(len(keys))])
        .limit(HOT_KEYS)
        .withColumn("__shards", F.ceil(F.col("__n") / rows_per_shard).cast("int"))
        .drop("__n")
    )
    hot_keys = [f"__k{i}" for i in range(len(keys))]

    def tagged(df: DataFrame, names: Sequence[str]) -> DataFrame:
        test = key_test(list(zip(names, hot_keys)), "t", "h", null_safe)
        return df.alias("t").join(F.broadcast(hot.alias("h")), test, "left")

    shards = F.col("__shards")
    spread = tagged(right, right_keys).select(
        *[col(c, "t") for c in right.columns],
        F.lit(True).alias("__here"),
        F.when(shards.isNotNull(), F.pmod(F.spark_partition_id(), shards)).otherwise(0).alias("__salt"),
    )
    copied = tagged(left, [a for a, _ in keys]).select(
        *[col(c, "t") for c in left.columns],
        shards.isNotNull().alias("__hot"),
        F.explode(F.when(shards.isNotNull(), F.sequence(F.lit(0), shards - 1)).otherwise(F.array(F.lit(0)))).alias(
            "__salt"
        ),
    )
    test = key_test(keys, "t1", "t2", null_safe) & (F.col("t1.__salt") == F.col("t2.__salt"))
    joined = copied.alias("t1").join(spread.alias("t2"), test, "left")
    # A hot key has matches, so a copy without one only met an empty shard.
    return joined.where(~(F.col("t1.__hot") & F.col("t2.__here").isNull()))
