"""The folder that driver and executors share, and tables staged in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def file_system(spark: SparkSession, path: str):
    """``path`` as Spark's own path, and its file system."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or else the checkpoint folder of its context.

    Only on one machine a temporary folder will do; on a cluster it is an error to have none.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lexloom-")
    return _own[app]


def app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lexloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for this application's own use; it is deleted when the application ends, or by :func:`clear`."""
    own, fs = file_system(spark, app_dir(spark))
    if not fs.exists(own):
        fs.mkdirs(own)
        fs.deleteOnExit(own)
    return f"{app_dir(spark)}/{uuid.uuid4().hex}/{name}"


def clear(spark: SparkSession) -> None:
    """Deletes what the application has staged; results that still read it must have been written before."""
    own, fs = file_system(spark, app_dir(spark))
    fs.delete(own, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts the lineage: a lost executor never causes the work behind it to run again,
    and several consumers share one computation.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df``, dealt anew by the columns ``by`` where its files have fewer splits than there are cores.

    Large inputs have more splits and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *by)
