"""Tables written to the folder that all machines share, to end a lineage."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir; nothing is made yet.

    Where that is unset, a temporary folder takes its place on a single machine;
    on a cluster, whose machines don't share one, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "motifloom")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote for the tables, which nothing may read any more."""
    for df in tables:
        spark = df.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets the cleaner delete the shuffle files of finished jobs; it does once the driver has let go of their plans."""
    spark.range(1).count()  # the last plan is held until another has run
    gc.collect()
    spark.sparkContext._jvm.System.gc()
