"""Where plans are cut: tables in the folder that all executors share, which are gone when the application ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, else what setCheckpointDir() was given. Where both are unset, a local master has a
    folder of this machine; on a cluster that is an error, as its executors share none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="weirflow-"))
    return _local[0]


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, of any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet, in a folder of the application's own that is deleted when the application ends."""
    folder = f"{shared_folder(spark)}/weirflow-{spark.sparkContext.applicationId}"
    p, store = hadoop_path(spark, folder)
    if not store.exists(p):
        store.mkdirs(p)
    store.deleteOnExit(p)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p, store = hadoop_path(spark, path)
    store.delete(p, True)


def cut(df: DataFrame, name: str = "cut", **options: str) -> DataFrame:
    """The frame's rows as a table in the shared folder: its lineage ends there, and no executor's loss takes it along.
    `options`: of the Parquet writer."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables of frames that cut() gave and that nothing reads any more; other frames are left as they are."""
    for df in frames:
        path = getattr(df, "cut_path", None)
        if path is not None:
            remove(df.sparkSession, path)
