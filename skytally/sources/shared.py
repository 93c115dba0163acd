"""The folder that the driver and all executors share, from ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; where none is set, one is made in local mode alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="skytally-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/skytally/{label}-{uuid.uuid4().hex}"
