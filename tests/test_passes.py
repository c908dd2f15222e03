"""Sliding medians and boxes against plain loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lumenread.operators import boxes, sliding


@pytest.mark.parametrize("rows,seconds", [(1, None), (5, None), (90, None), (None, 0.0), (None, 3.0), (None, 1e9)])
def test_sliding_median(spark, rows, seconds):
    rng = random.Random(4)
    data = [(rng.choice([1, 2, None]), t, rng.choice([None, float("nan"), *range(6)])) for t in range(300)]
    if seconds is not None:
        data = [(k, t // 3, v) for k, t, v in data]
    data = [(k, float(t), None if v is None else float(v), n) for n, (k, t, v) in enumerate(data)]
    frame = spark.createDataFrame(data, "k int, t double, v double, id int").withColumn("window_x", F.lit(1))
    found = {r["id"]: (r["window_n"], r["window_median"]) for r in sliding.sliding_median(frame, "k", "t", "v", rows, seconds).collect()}
    for k, t, _, n in data:
        if rows is not None:
            mine = [v for kk, _, v, m in data if kk == k and m <= n][-rows:]
            size = len(mine)
        else:
            mine = [v for kk, tt, v, _ in data if kk == k and t - seconds <= tt <= t]
            size = sum(v is not None and v == v for v in mine)
        values = [v for v in mine if v is not None and v == v]
        assert found[n] == (size, statistics.median(values) if values else None)


def test_sliding_edges(spark):
    frame = spark.createDataFrame([], "k int, t double, v double")
    assert sliding.sliding_median(frame, "k", "t", "v", last_rows=3).count() == 0
    frame = spark.createDataFrame([(1, None, 5.0), (1, 1.0, 7.0)], "k int, t double, v double")
    assert sorted(map(str, sliding.sliding_median(frame, "k", "t", "v", seconds=9.0).toPandas().window_n)) == ["0", "1"]
    with pytest.raises(ValueError):
        sliding.sliding_median(frame, "k", "t", "v")


def plain(point, layout, band, gap):
    _, x, y = point
    if x is None or y is None or not layout:
        return None, None
    centres = sorted({(b[2] + b[4]) / 2 for b in layout})
    line = min(centres, key=lambda c: abs(y - c))
    if abs(y - line) > band:
        return None, None
    return line, next((b[0] for b in sorted(layout) if (b[2] + b[4]) / 2 == line and b[1] - gap / 2 <= x <= b[3] + gap / 2), None)


@pytest.mark.parametrize("band,gap,width", [(7.0, 4.0, 10.0), (20.0, 0.0, 1000.0), (1.5, 30.0, 3.0)])
def test_boxes(spark, band, gap, width):
    rng = random.Random(6)
    layouts = {k: [(n, x := rng.randint(-20, 60), y := rng.choice([0, 10, 13, 40]), x + rng.randint(0, 25), y + rng.choice([4, 10])) for n in range(rng.randint(1, 12))] for k in range(12)}
    points = [(n, rng.choice([*range(14), None]), *(rng.choice([None, *(v / 2 for v in range(-60, 160))]) for _ in range(2))) for n in range(800)]
    rows = [(k, *map(float, b[1:]), b[0]) for k, own in layouts.items() for b in own] + [(1, None, 0.0, 1.0, 1.0, 99)]
    table = spark.createDataFrame(rows, "layout int, x1 double, y1 double, x2 double, y2 double, index int")
    frame = spark.createDataFrame(points, "id int, layout int, x double, y double").withColumn("note", F.lit("kept"))
    found = boxes.assign_boxes(frame, table, band, gap, width).collect()
    assert len(found) == 800 and all(r["note"] == "kept" for r in found)
    told = {r["id"]: (r["line"], r["box"]) for r in found}
    for n, layout, x, y in points:
        line, box = plain((layout, x, y), layouts.get(layout, []), band, gap)
        assert told[n][1] == box and (x is None or told[n][0] == line)
    assert boxes.assign_boxes(frame.limit(0), table, band, gap).count() == 0 and boxes.assign_boxes(frame, table.limit(0), band, gap).filter("line is not null").count() == 0
