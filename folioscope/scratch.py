"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where one machine runs all and names no folder, as in tests.
LOCAL = "file:///tmp/checkpoints/folioscope"


def folder(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written and read again, which cuts its lineage, and the path."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
