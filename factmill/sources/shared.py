"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder: the session's spark.checkpoint.dir. Only a session on one machine may do without."""
    given = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factmill-"))
        given = spark.sparkContext.getCheckpointDir()
    return given


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """`df`, written as Parquet to the shared folder and reread: later steps don't recompute it, and survive lost executors.

    The driver's JVM deletes it when it ends, or `discard` before.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = at
    return out


def discard(df: DataFrame) -> None:
    """Deletes a written table that nothing will read again."""
    df._written_at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(df._written_at, True)
