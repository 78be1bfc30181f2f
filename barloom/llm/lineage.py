"""Cutting lineage in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only on a local master where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='barloom-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; Spark deletes it when nothing refers to it any more."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` as Parquet in the shared folder: compressed and read by column, for wide rows that are read more than once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df``, kept, with a number of its own for each row (``row``); numbers follow ``order``, if given.

    The numbers are written once, so they stay the same whatever is lost or computed again.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(df.withColumn("row", F.monotonically_increasing_id()), compression="zstd")


def forget(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote for these tables, and lets Spark drop shuffle files that no table refers to any more.

    Call it when everything computed from the tables is itself kept.
    """
    for df in frames:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if (active := SparkSession.getActiveSession()) is not None:
        for _ in range(2):  # what Python lets go of reaches the JVM a moment later
            gc.collect()
            active._jvm.System.gc()
            time.sleep(0.2)
