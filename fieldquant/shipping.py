"""Sends the package to the executors' Python, for functions that run there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the executors' path, once for a context; Spark serves the file to late executors too."""
    sc = spark.sparkContext
    if getattr(sc, "_fieldquant_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="fieldquant-")), "fieldquant_code.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(to)
    sc._fieldquant_shipped = True
