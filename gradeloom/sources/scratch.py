"""Where intermediate files go, and tables stored there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new path below the shared folder that the cluster names; local sessions without one get a temporary folder.

    Nothing is there yet; what is written goes when the session's JVM ends.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoints-")
    own = f"{base.rstrip('/')}/gradeloom-{uuid.uuid4().hex}"
    fs, target = file_system(spark, own)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return f"{own}/data"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def stored(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there, and no work runs twice.

    ``by``: columns of few values whose folders a filter on them reads alone; they come last.

    Spark knows the size of what it reads back, so it broadcasts such a table only below its threshold.  The files go when
    the session's JVM ends, or before that by ``discard``.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored_tables: DataFrame) -> None:
    """Delete the files of tables from ``stored`` that nothing will read again."""
    for df in stored_tables:
        drop_folder(df.sparkSession, df._stored_at)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete what a path from ``scratch_folder`` holds."""
    fs, target = file_system(spark, path.rpartition("/")[0])
    fs.delete(target, True)
