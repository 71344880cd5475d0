"""Sinks that never overwrite: append after a conflict check, and atomic publication."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.operators.history import conflicts


class Conflict(ValueError):
    """A stored id was given another payload."""


def append_checked(new: DataFrame, path: str, key: list[str], payload: list[str]) -> int:
    """Appends the rows whose key isn't stored yet; identical ones are reused, others stop the whole write."""
    spark = new.sparkSession
    if not _exists(spark, path):
        new.write.parquet(path)
        return new.count()
    old = spark.read.parquet(path)
    verdicts = conflicts(new, old, key, payload)
    bad = verdicts.where("verdict = 'conflict'").limit(5).collect()
    if bad:
        raise Conflict(f"other payloads for {[tuple(r[k] for k in key) for r in bad]}")
    fresh = new.join(verdicts.where("verdict = 'new'").select(*key), key, "left_semi").select(*old.columns)
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def publish(df: DataFrame, path: str) -> str:
    """Writes to a folder of another name, then renames it; an existing publication with the same content is reused."""
    spark = df.sparkSession
    digest = df.select(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")).cast("string").alias("h"), F.count("*").alias("n")).first()
    mark = json.dumps({"digest": digest["h"], "rows": digest["n"]})
    if _exists(spark, path):
        if spark.read.text(f"{path}/_publication").first()[0] != mark:
            raise Conflict(f"{path} holds another publication")
        return "reused"
    work = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(f"{work}/data")
    spark.createDataFrame([(mark,)], "value string").coalesce(1).write.text(f"{work}/_publication")
    fs, at = _fs(spark, path)
    if not fs.rename(_path(spark, work), at):
        fs.delete(_path(spark, work), True)
        raise Conflict(f"{path} appeared meanwhile")
    return "published"


def trace(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines; a failed write raises."""
    df.write.mode("append").json(path)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    at = _path(spark, path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)
