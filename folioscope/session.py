"""What a session needs before Python functions of this package run on its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds this package to the executors' import path, once an application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        home = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp()) / "folioscope.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(home.rglob("*.py")):
                z.write(p, p.relative_to(home.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark
