"""Intermediate tables in the folder that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: What was chosen for an application whose session names no folder: Spark lets nobody set one in a running session.
_chosen: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else a folder in the warehouse.

    Where driver and executors are one process and no folder is set, as in tests, a temporary one will do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if sc.applicationId not in _chosen:
        if sc.master == "local" or sc.master.startswith("local["):
            _chosen[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        else:
            _chosen[sc.applicationId] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return _chosen[sc.applicationId]


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
