"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset, a temporary folder in local mode and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Remove the tables that this application has written, once no result needs them."""
    _remove(spark, own_dir(spark))


def exact(rows: DataFrame, *totals: str) -> DataFrame:
    """A small result with its exact DECIMAL totals as BIGINT, if all of them fit, else as they are.

    Sums over a whole ledger outgrow 64 bits at some size; the result is written once, as its type depends on it.
    """
    done = written(rows, False)
    beyond = F.lit(False)
    for c in totals:
        beyond = beyond | (F.col(c).isNotNull() & F.col(c).try_cast("long").isNull())
    return done.withColumns({c: F.col(c).cast("long") for c in totals}) if done.where(beyond).isEmpty() else done


def discard(*tables: DataFrame) -> None:
    """Remove tables that `written` gave back, once what was made of them is written too."""
    for table in tables:
        folder = getattr(table, "_scratch_folder", None)
        if folder:
            _remove(table.sparkSession, folder)


def written(df: DataFrame, release: bool = True) -> DataFrame:
    """Write df once to the shared folder and read it again: cuts lineage, and a lost executor costs no recomputation.

    Shuffle files of what has been written are no longer needed; Spark removes them when the driver's garbage
    collection finds their owners gone, so it is asked to run, unless the tables are small.
    """
    path = f"{own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    schema = df.schema
    spark = df.sparkSession
    df.write.parquet(path)
    del df
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(schema).parquet(path)
    table._scratch_folder = path
    return table
