"""A Spark session with the settings the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even when that costs another shuffle further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Otherwise "SELECT * FROM t WHERE" is a query whose table is aliased WHERE.
    "spark.sql.ansi.enforceReservedKeywords": "true",
    # "name" is a column or table, 'text' a text.
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
}
SETTINGS = {
    **TUNING,
    # Call sites for error messages cost about half of the time a plan takes to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.dataFrameQueryContext.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(builder: SparkSession.Builder | None = None) -> SparkSession.Builder:
    builder = builder or SparkSession.builder
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def tune(spark: SparkSession) -> SparkSession:
    """Switch the adaptive handling of hot keys, and the rules SQL text is read by, on in a session built elsewhere."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark
