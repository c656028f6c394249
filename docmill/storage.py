"""Cutting lineage through files that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only in local mode, where that may be unset, a temporary one; a cluster must name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-docmill-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/docmill-{uuid.uuid4().hex}"


def materialise(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; survives lost executors."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path, compression=compression)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._docmill_path = path
    return back


def sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that is not to be broadcast: Spark judges by the size of compressed files, of which far more is made, and a broadcast goes through the driver's memory."""
    return df.hint("merge")


def release(df: DataFrame) -> None:
    """Delete the files behind a materialised frame that no later plan reads."""
    path = getattr(df, "_docmill_path", None)
    if path is not None:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`shared_path` named."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
