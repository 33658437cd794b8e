"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares; in a local temporary folder only where none is set, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{top.rstrip('/')}/{name}-{uuid4().hex}"
