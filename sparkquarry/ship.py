"""Make the package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def to_workers(spark: SparkSession) -> None:
    """Send the package to the workers once per SparkContext (driver-side file, served by Spark)."""
    context = spark.sparkContext
    if getattr(context, "_sparkquarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="sparkquarry"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(archive)
    context._sparkquarry_shipped = True
