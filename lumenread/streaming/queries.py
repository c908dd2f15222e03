"""Streams over the given tables: each call runs to the end of what is there and leaves its folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenread.operators.depths import shared_folder
from lumenread.sources import tables
from lumenread.streaming import fixations, gaze

_STATE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB."""
    before = spark.conf.get(_STATE, None)
    spark.conf.set(_STATE, fixations.PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STATE)
        else:
            spark.conf.set(_STATE, before)


def source(spark: SparkSession, sf_dir: str, table: str, files: int | None = None) -> DataFrame:
    """A table as a stream of its files, some at a time if asked for."""
    path = f"{sf_dir}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # a pattern, as a stream's path by itself has to be a folder and a table can be one file
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(f"{path}*")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream has put out by the end of its source, from a new folder."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/lumenread-{uuid.uuid4().hex}-{name}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def live_fixations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixations of all users' events that have closed by the end of the log."""
    events = source(spark, sf_dir, "events")
    samples = events.select(
        F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.get_json_object("props", "$.k").cast("int") % tables.WORDS * 10.0).alias("x"),
        F.col("value").alias("y"), F.lit(False).alias("off"))
    with rocks_state(spark):
        return drained(fixations.fixation_stream(samples, spread=80.0, gap=3 * 86400.0, least=60.0, interval=3600.0, late="1 day", idle=30 * 86400.0), "fixations")


def live_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks without retries: of rows that came again within a day, one of each click, with the columns that retries share."""
    clicks = source(spark, sf_dir, "clicks").filter("click_id is not null and arrived_at is not null")
    rows = clicks.select(F.lit("click").alias("pid"), F.lit(False).alias("practice"), F.col("click_id").cast("string").alias("sid"), F.col("arrived_at").cast("timestamp").alias("ts"))
    return drained(gaze.uploads(rows).select("sid"), "uploads")


QUERIES = {"live_fixations": live_fixations, "live_uploads": live_uploads}
