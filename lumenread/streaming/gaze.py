"""Streaming twins of the gaze operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAMES, ACTIVE = 90, 15


def blink_filter(samples: DataFrame, ratio: float = 0.6) -> DataFrame:
    """key, t, value, blink: whether a sample is under ratio times the median of the last FRAMES, once there are ACTIVE."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        for part in parts:
            part = part.sort_values("t", kind="stable")
            flags = []
            for value in part["value"]:
                last = [*last, float(value)][-FRAMES:]
                flags.append(len(last) >= ACTIVE and value < ratio * float(pd.Series(last).median()))
            yield part.assign(blink=flags)[["key", "t", "value", "blink"]]
        state.update((last,))

    return samples.select("key", "t", "value").groupBy("key").applyInPandasWithState(
        step, "key long, t double, value double, blink boolean", "last array<double>", "append", GroupStateTimeout.NoTimeout)


def uploads(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Uploads without retries: one row of (pid, practice, sid) within the time that a retry may come late."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["pid", "practice", "sid"])


def on_screen(samples: DataFrame, width: float, height: float, margin: float = 0.1) -> DataFrame:
    """Samples on the screen or at most a margin's share beyond it."""
    return samples.filter(F.col("x").between(-margin * width, (1 + margin) * width) & F.col("y").between(-margin * height, (1 + margin) * height))


def event_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events of each type in tumbling windows (not part of the reading pipeline; handy for logs)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sample_source(spark: SparkSession, path: str, rows_a_trigger: int = 1000) -> DataFrame:
    """Live samples (key, t, x, y, valid, reason) from the JSON files that a tracker drops into a folder."""
    schema = "key long, t double, x double, y double, valid boolean, reason string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, rows_a_trigger // 1000)).json(path)


def valid_samples(samples: DataFrame) -> DataFrame:
    """Samples that the tracker calls valid, with why others weren't counted elsewhere."""
    return samples.filter(F.col("valid") & F.col("x").isNotNull() & F.col("y").isNotNull())
