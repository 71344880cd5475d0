"""Readers, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from factmill.sources import readers, writers
from factmill.streaming import progress


def test_json_lines_rejects(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "q": "x", "other": 2}\n\nnot json\n{"id": "z"}\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "a.jsonl"), "id int, q string")
    assert [tuple(r) for r in good.collect()] == [(1, "x")]
    assert bad.count() == 2


def test_page_numbers():
    assert readers.page_numbers("1-3,5", 6) == [1, 2, 3, 5]
    assert readers.page_numbers("", 2) == [1, 2]
    with pytest.raises(ValueError, match="1..4"):
        readers.page_numbers("3-5", 4)


def test_typed_cells(spark):
    cells = spark.createDataFrame([("1,000.5", "million"), ("—", "million"), ("abc", "yuan"), ("3", "dozen")], "text string, unit string")
    got = readers.typed_cells(cells, F.col("unit")).collect()
    assert [r["status"] for r in got] == ["numeric", "empty", "unparsable", "unknown_unit"]
    assert float(got[0]["value"]) == 1000.5e6


def test_append_checked(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "id int, v string")
    assert writers.append_checked(rows((1, "a"), (2, "b")), path, ["id"], ["v"]) == 2
    assert writers.append_checked(rows((2, "b"), (3, "c")), path, ["id"], ["v"]) == 1
    with pytest.raises(writers.Conflict):
        writers.append_checked(rows((4, "d"), (3, "x")), path, ["id"], ["v"])
    assert spark.read.parquet(path).count() == 3


def test_publish(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    assert writers.publish(df, path) == "published"
    assert writers.publish(df, path) == "reused"
    with pytest.raises(writers.Conflict):
        writers.publish(df.where("id > 0"), path)


def test_stream_windows_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(src))
    stream = progress.windowed(progress.read_events(spark, str(src)), late="3650 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.sql("select * from windows").collect()}
    batch = progress.windowed(spark.read.parquet(str(src))).collect()
    assert got == {(r["start"], r["event_type"]): r["n"] for r in batch}


def test_stream_latest(spark, tmp_path):
    src = tmp_path / "in"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(src))
    q = progress.latest(progress.read_events(spark, str(src), files=10)).writeStream.outputMode("update").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["user_id"], r["event_type"]): r["event_id"] for r in spark.sql("select * from latest").collect()}
    want = events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()
    assert got == {(r["user_id"], r["event_type"]): r["e"] for r in want}
