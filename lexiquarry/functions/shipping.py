"""Makes this package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_lexiquarry_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lexiquarry-src-"), "lexiquarry_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, f"{_ROOT.name}/{p.relative_to(_ROOT)}")
    context.addPyFile(path)
    context._lexiquarry_shipped = True
