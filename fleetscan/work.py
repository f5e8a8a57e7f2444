"""The work folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    ``spark.checkpoint.dir`` where it is set.  Otherwise a temporary folder in local
    mode (tests), and on a cluster the warehouse where it is in a store of its own: a folder
    of one machine is an error there.
    """
    global _LOCAL
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        if _LOCAL is None or not os.path.isdir(_LOCAL):
            _LOCAL = tempfile.mkdtemp(prefix="fleetscan-")
        return "file://" + _LOCAL
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if "://" not in warehouse or warehouse.startswith("file:"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return warehouse + "/_work"


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
