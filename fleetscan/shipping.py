"""Shipping of this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application.

    Functions are pickled by reference, so that per-worker caches (compiled automata,
    tokenizers) live as long as the reused worker.
    """
    sc = spark.sparkContext
    if getattr(sc, "_fleetscan_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="fleetscan-ship-")
    target = os.path.join(folder, "fleetscan_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            if "__pycache__" in d:
                continue
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("fleetscan", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._fleetscan_shipped = True
