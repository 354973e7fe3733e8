"""Size checks made before a side of a join may be sent to every executor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate for a result, or None where the session cannot tell."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    """The session's own automatic broadcast bound in bytes; 0 when broadcasting is off."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    units = {"b": 1, "k": 2**10, "kb": 2**10, "m": 2**20, "mb": 2**20, "g": 2**30, "gb": 2**30}
    for suffix in sorted(units, key=len, reverse=True):
        if text.endswith(suffix):
            return max(0, int(text[: -len(suffix)]) * units[suffix])
    return max(0, int(text))


def known_large(df: DataFrame, least: int = 10 << 20) -> bool:
    """The estimate says that a side is beyond the bound, or beyond ``least`` where broadcasting is off. Rows given by the caller have no estimate."""
    size = estimated_bytes(df)
    return size is not None and max(least, broadcast_limit(df.sparkSession)) < size < 2**62


def fits_broadcast(df: DataFrame) -> bool:
    """True only when the estimate is known and within the bound."""
    size = estimated_bytes(df)
    return size is not None and size <= broadcast_limit(df.sparkSession)
