"""Cutting lineage with written tables in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the context's checkpoint folder.

    Only a local session may do without: it gets a temporary folder of this process. On a
    cluster such a folder would be a different one on every machine, so there it raises."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir is unset, but with master {master} intermediate tables need a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="emberline-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return "file://" + _OWN[0]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/emberline/{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the application ends or by `release`."""
    folder = _folder(spark)
    fs, at = _file_system(spark, folder)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{folder}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Removes every table that this application has written so far; for use between queries,
    when no result that was made from them is read any more."""
    fs, at = _file_system(spark, _folder(spark))
    fs.delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """`df` written as parquet into the shared folder and read back.

    The rows are computed once, every later use reads the files, and a lost executor costs
    a re-read instead of a recomputation. Unlike checkpoint() the last stage runs once only.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._emberline_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes the table of a frame that came from `written`, for states of a loop that the
    next state has replaced. Nothing may read it, or a frame made from it, afterwards."""
    fs, at = _file_system(df.sparkSession, df._emberline_path)
    fs.delete(at, True)
