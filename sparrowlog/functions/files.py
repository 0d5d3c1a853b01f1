"""Folders that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see. Where the session names none, a temporary one in local mode; a cluster must name one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="sparrowlog-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
