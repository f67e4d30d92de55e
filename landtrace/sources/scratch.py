"""Shared scratch space for results that have to be written."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, else under the warehouse; a cluster shares both."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/landtrace/{label}-{uuid.uuid4().hex}"
