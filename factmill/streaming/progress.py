"""Event streams: windowed counts with late data, and the last state of each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; a window's row is emitted when the watermark has passed its end."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event id once, for as long as a repeat can arrive."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest(events: DataFrame) -> DataFrame:
    """The latest event of each user and type so far, kept as state; rows are emitted as they change."""
    schema = "user_id long, event_type string, ts timestamp, event_id long, value double"

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for part in parts:
            row = part.sort_values(["ts", "event_id"]).iloc[-1]
            mine = (row["ts"].to_pydatetime(), int(row["event_id"]), float(row["value"]))
            if best is None or mine[:2] > tuple(best)[:2]:
                best = mine
        if best is not None:
            state.update(tuple(best))
            yield pd.DataFrame([{"user_id": key[0], "event_type": key[1], "ts": best[0], "event_id": best[1], "value": best[2]}])

    return events.groupBy("user_id", "event_type").applyInPandasWithState(fold, schema, "ts timestamp, event_id long, value double", "update", GroupStateTimeout.NoTimeout)


def write_once(stream: DataFrame, path: str, checkpoint: str):
    """Appends each batch to its own folder; a batch that is repeated after a failure replaces what it wrote."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
