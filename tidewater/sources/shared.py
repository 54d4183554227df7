"""Folders for what a query stores on the way: below the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path for ``name``. Where the session names no shared folder, a local one if all of Spark is this process; on a cluster an error.
    All of one application lies below ``tidewater-<its id>``, which :func:`clear` removes."""
    return f"{_home(spark)}/{name}-{uuid.uuid4().hex}"


def _home(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return f"{named.rstrip('/')}/tidewater-{sc.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes what queries of this application have stored: after their results have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_home(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
