"""Medians of what came before, along one ordered pass.

Rows are dealt by key and sorted; a task goes through them once and keeps the values of the window at
hand in order, taking in one and giving up those that have left. What it holds is one window, and
no row carries a list.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenread.sources import tables


class Window:
    """The values of the last rows or seconds, in order of size as well."""

    def __init__(self, rows: int | None = None, seconds: float | None = None):
        self.rows, self.seconds = rows, seconds
        self.came: deque[tuple[float, float | None]] = deque()
        self.sorted: list[float] = []

    def take(self, at: float, value: float | None) -> None:
        """Take in a value (null: a row that counts as a row only) and give up what has left."""
        self.came.append((at, value))
        if value is not None:
            insort(self.sorted, value)
        while (self.rows is not None and len(self.came) > self.rows) or (self.seconds is not None and self.came[0][0] < at - self.seconds):
            _, gone = self.came.popleft()
            if gone is not None:
                del self.sorted[bisect_left(self.sorted, gone)]

    def median(self) -> float | None:
        n = len(self.sorted)
        return None if not n else self.sorted[n // 2] if n % 2 else (self.sorted[n // 2 - 1] + self.sorted[n // 2]) / 2


def sliding_median(rows: DataFrame, key: str, order: str, value: str, last_rows: int | None = None, seconds: float | None = None) -> DataFrame:
    """rows with window_n and window_median of value over the last rows, or the last seconds of order, of each key.

    Rows of one time see each other if the window is in seconds (as a range does), and the rows before
    them in any order if it is in rows. Null values and NaN aren't counted in windows of seconds; in windows of rows they
    take a place. Rows without a time come first and have no window of seconds.
    """
    if (last_rows is None) == (seconds is None):
        raise ValueError("a window is of rows or of seconds")
    names = rows.columns
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), "window_n long", "window_median double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, window = object(), Window(last_rows, seconds)
        held: list[tuple] = []  # rows of one time, which wait for each other
        kinds: list[pa.Field] = []

        def made(told: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*told, strict=True)) if told else [()] * (len(kinds) + 2)
            types = [*(f.type for f in kinds), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*names, "window_n", "window_median"])

        def told(ready: list[tuple]) -> list[tuple]:
            n = len(window.sorted) if seconds is not None else len(window.came)
            return [(*r, n, window.median()) for r in ready]

        place = names.index(key), names.index(order), names.index(value)
        for batch in batches:
            kinds = list(batch.schema)
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k, at, v = (row[p] for p in place)
                v = None if v is None or v != v else float(v)
                if k != of or (held and (last_rows is not None or held[-1][place[1]] != at)):
                    out += told(held)
                    held = []
                if k != of:
                    of, window = k, Window(last_rows, seconds)
                if seconds is not None and at is None:
                    out.append((*row, 0, None))
                    continue
                window.take(at, v)
                held.append(row)
            yield made(out)
        if held:
            yield made(told(held))

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def rolling_blink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples below 0.6 of the median of the last 90, once there are 15."""
    found = sliding_median(tables.fixations(spark, sf_dir).select("user_id", "i", "d"), "user_id", "i", "d", last_rows=90)
    blink = (F.col("window_n") >= 15) & (F.col("d") < 0.6 * F.col("window_median"))
    return found.select("user_id", "i", F.col("window_n").alias("frames"), F.when(blink, 1).otherwise(0).alias("blink"))


def _drift(seconds: float, least: int):
    """The median of the valid samples in some time before each anchor, applied from some samples on."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = tables.fixations(spark, sf_dir).select("user_id", "i", "w", "t", F.when(F.col("w") != 0, F.col("d")).alias("y"))
        found = sliding_median(rows, "user_id", "t", "y", seconds=seconds).filter("w = 3")
        return found.select("user_id", "i", F.col("window_n").alias("n"), F.round(F.when(F.col("window_n") >= least, F.col("window_median")).otherwise(0.0), 6).alias("offset_y"))

    return query


def _drift_sql(seconds: float, least: int) -> str:
    frame = f"over (partition by user_id order by t range between {seconds}e0 preceding and current row)"
    return f"""with f as ({tables.FIX_SQL}), x as (select user_id, i, w, count(case when w <> 0 then d end) {frame} as n, quantile_cont(case when w <> 0 then d end, 0.5) {frame} as m from f) select user_id, i, n, round(case when n >= {least} then m else 0 end, 6) as offset_y from x where w = 3"""


QUERIES = {"rolling_blink": rolling_blink, "drift_offset": _drift(86400, 2), "drift_median": _drift(43200, 5)}
ORACLE = {
    "rolling_blink": f"""with f as ({tables.FIX_SQL}) select user_id, i, count(*) over w90 as frames, case when count(*) over w90 >= 15 and d < 0.6 * quantile_cont(d, 0.5) over w90 then 1 else 0 end as blink from f window w90 as (partition by user_id order by i rows between 89 preceding and current row)""",
    "drift_offset": _drift_sql(86400, 2), "drift_median": _drift_sql(43200, 5)}
