"""Arrow batches, and the shared folder: lineage is cut only through reliable checkpoints."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

from kinweave.sources.shared import cut, drop_path, fresh_path, shared_dir

__all__ = ["arrow_rows", "cut", "drop_path", "fresh_path", "shared_dir", "small_batches"]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts stay small, unless the session says how large they are to be."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows in what is planned meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
