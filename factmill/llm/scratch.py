"""Session settings of the operators, and the written tables that they share with the rest of the library."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession

from factmill.sources.shared import discard, folder, written

__all__ = ["arrow_rows", "discard", "folder", "release", "shuffle_partitions", "written"]

#: Rows of a batch that goes to a Python worker; long texts make larger batches costly.
ARROW_ROWS = 1024


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the rows of a batch, and so a Python worker's memory, from now on in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files that no live DataFrame refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
