"""The folder that all executors share: what outlives a job is written there, and lineage is cut there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, one is set: a temporary folder if all runs in this process, else one below the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        here = re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master)
        found = tempfile.mkdtemp(prefix="kinweave-") if here else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/kinweave-checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what a step wrote below the shared folder, once nothing reads it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Evaluate ``df`` once into the shared folder and go on from the files."""
    spark = df.sparkSession
    shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
