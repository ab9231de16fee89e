"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


@cache
def _temporary(application: str) -> str:
    """One folder for each application, kept here because Spark lets no running session set ``spark.checkpoint.dir``."""
    return f"file://{tempfile.mkdtemp(prefix='quernel-')}"


def shared_place(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; local sessions that leave it unset get a temporary folder, others an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _temporary(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
