"""The folder that driver and executors share, and what is kept there for a while."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A session on one machine without it gets a folder of its own, gone when the
    driver ends; on a cluster that would be a folder which no executor shares, so there it is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quarry-checkpoint-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with its file system's scheme."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def reliable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
