"""Where tables and scratch results are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared one (``spark.checkpoint.dir``). Only a local session
    without that setting gets a folder on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tributary-")
    return f"{base.rstrip('/')}/tributary/{purpose}-{uuid.uuid4().hex}"
