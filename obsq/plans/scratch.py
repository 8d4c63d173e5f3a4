"""A folder that the driver and all executors share, for tables a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from obsq.errors import RequestError


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``, which nothing else uses.

    Where that is unset, a session in one process gets a temporary folder; on a
    cluster it is an error, as executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RequestError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="obsq-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
