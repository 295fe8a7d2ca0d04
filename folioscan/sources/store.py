"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds from one collection to the next at least.
COLLECT_EVERY = 1.0
_collected = [0.0]


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a local master, and an error on a
    cluster, whose executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="folioscan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _drop_consumed(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no frame refers to any more; a driver with little to do hardly collects by itself.

    Listeners hold the plan that ended last until another ends, hence the query without a job.
    """
    if time.monotonic() - _collected[0] > COLLECT_EVERY:
        spark.sql("SELECT 1").collect()
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


def materialize(df: DataFrame, label: str = "part") -> DataFrame:
    """Write df to the shared folder and read it back.

    Lineage is cut at a durable copy, so a lost executor costs at most the running stage. Shuffle files behind earlier
    copies are dropped before the next is written.
    """
    spark, schema = df.sparkSession, df.schema
    _drop_consumed(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete tables that materialize() has written, once all that reads them is itself a durable copy."""
    for df in stored:
        spark = df.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
