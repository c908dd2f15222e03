"""Streaming operators against plain versions of the same rules."""

import datetime as dt
import statistics

from lumenread.streaming import gaze


def run(frame, name, path):
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    return frame.sparkSession.table(name).collect()


def test_blinks(spark, tmp_path):
    rows = [(k, float(i), 1.0 + 0.01 * (i % 7) if i % 23 else 0.2) for k in (1, 2) for i in range(120)]
    source = spark.createDataFrame(rows, "key long, t double, value double")
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = {(r["key"], r["t"]): r["blink"] for r in run(gaze.blink_filter(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))), "blinks", tmp_path)}
    for key in (1, 2):
        values = [v for k, _, v in rows if k == key]
        for i, value in enumerate(values):
            last = values[max(0, i - 89): i + 1]
            assert found[key, float(i)] == (len(last) >= 15 and value < 0.6 * statistics.median(last))


def test_uploads(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    rows = [("p1", False, "s1", at, 1.0), ("p1", False, "s1", at, 2.0), ("p1", True, "s1", at, 3.0), ("p2", False, "s1", at, 4.0)]
    source = spark.createDataFrame(rows, "pid string, practice boolean, sid string, ts timestamp, rt double")
    source.coalesce(1).write.parquet(str(tmp_path / "up"))
    found = run(gaze.uploads(spark.readStream.schema(source.schema).parquet(str(tmp_path / "up"))), "uploads", tmp_path)
    assert sorted((r["pid"], r["practice"]) for r in found) == [("p1", False), ("p1", True), ("p2", False)]


def test_on_screen(spark):
    frame = spark.createDataFrame([(50.0, 50.0), (-9.0, 0.0), (-11.0, 0.0), (109.0, 111.0)], "x double, y double")
    assert gaze.on_screen(frame, 100, 100).count() == 2
