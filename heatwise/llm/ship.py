"""Give the executors' Python this package, as ``--py-files`` would."""
from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Add the package's source to the session's Python files, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_heatwise_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    above = os.path.dirname(package)
    handle, path = tempfile.mkstemp(prefix="heatwise-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, above))
    sc.addPyFile(path)
    sc._heatwise_shipped = True
