"""Folders for tables that cut lineage, on storage that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

MADE: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, or, on a local master only, a temporary one. It goes when the application ends."""
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='stratum-')}"
    path = f"{str(at).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    MADE.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def clean() -> None:
    for spark, path in MADE:
        try:
            if spark.sparkContext._jsc and not spark.sparkContext._jsc.sc().isStopped():
                delete(spark, path)
        except Exception as e:  # the application ends anyway
            print(f"{path} may be left: {type(e).__name__}")
