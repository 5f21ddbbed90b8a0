"""Fresh folders in the place that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; on a local master without it, below a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="keyloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{str(root).rstrip('/')}/keyloom/{label}-{uuid.uuid4().hex}"
