"""Fixations from a live stream of samples, with state that timers end.

Each trial keeps the samples that the watermark hasn't passed yet and those of the window at hand.
As the watermark passes, samples are taken in order of time: a window of samples grows while its
spread and the gaps stay in bounds; when it can't, it is a fixation if it lasted long enough, and goes out
at once. A row with off ends the trial; a trial without one ends by a timer, idle seconds after its last
sample. Samples that come later than the watermark's delay, or after samples of a later time were taken, are
dropped, as they could only change what has gone out already.

Times are seconds; a window lasts until one sample interval after its last sample, so the interval of
the tracker is given. State is kept in RocksDB: a restart goes on where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "key long, start_t double, end_t double, x double, y double, samples long"
SAMPLE = "t double, x double, y double, off boolean"
#: What a row of a trial's state is.
WAITING, WINDOW, TAKEN = range(3)
#: Fewer samples make no fixation.
LEAST_SAMPLES = 2


def grown(todo: list[tuple], first: int, spread: float, gap: float) -> int:
    """Where the samples end that stay in bounds together with the one at first."""
    _, left, top, _ = todo[first]
    right, low = left, top
    for at in range(first + 1, len(todo)):
        t, x, y, _ = todo[at]
        left, right, top, low = min(left, x), max(right, x), max(top, y), min(low, y)
        if not (t - todo[at - 1][0] <= gap and right - left + top - low <= spread):
            return at
    return len(todo)


def close(window: list[tuple], rest: list[tuple], spread: float, gap: float, least: float, interval: float, ended: bool) -> tuple[list[tuple], list[list[tuple]]]:
    """The window that is still open and the fixations that are done, after a window and the samples behind it.

    A window that can't grow goes out if it is long enough, else it begins one sample later and what is behind comes again.
    """
    done = []
    todo, first = [*window, *rest], 0
    while first < len(todo):
        end = grown(todo, first, spread, gap)
        if end == len(todo) and not ended:
            return todo[first:], done
        if todo[end - 1][0] - todo[first][0] + interval >= least:
            if end - first >= LEAST_SAMPLES:
                done.append(todo[first:end])
            first = end
        else:
            first += 1
    return [], done


class FixationProcessor(StatefulProcessor):
    """The state of a trial: samples in wait, the window at hand, and how far samples were taken."""

    def __init__(self, spread: float, gap: float, least: float, interval: float, idle: float):
        self.bounds, self.interval, self.idle = (spread, gap, least), interval, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", f"part int, {SAMPLE}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self._held()
        last = max((s[0] for s in held[TAKEN]), default=float("-inf"))
        held[WAITING].extend([(float(r.t), float(r.x), float(r.y), bool(r.off)) for part in rows for r in part.itertuples(index=False) if r.t > last or r.off and r.t >= last])
        yield self._go_on(key, timerValues, held)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._go_on(key, timerValues, self._held())

    def _held(self) -> tuple[list[tuple], list[tuple], list[tuple]]:
        """The trial's samples in wait, those of the window at hand, and the time that samples were taken to."""
        held: tuple[list[tuple], ...] = ([], [], [])
        for part, *sample in self.samples.get():
            held[part].append(tuple(sample))
        return held

    def _go_on(self, key: Any, timerValues: Any, held: tuple[list[tuple], list[tuple], list[tuple]]) -> pd.DataFrame:
        """Take the samples that the watermark has passed; the fixations that are done by that."""
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        waiting, window = sorted(set(held[WAITING])), held[WINDOW]
        ready, later = [s for s in waiting if s[0] < passed], [s for s in waiting if s[0] >= passed]
        last = held[TAKEN][0][0] if held[TAKEN] else None
        done: list[list[tuple]] = []
        pending: list[tuple] = []
        for sample in ready:
            last = sample[0]
            if sample[3]:
                window, more = close(window, pending, *self.bounds, self.interval, True)
                done, pending = done + more, []
            else:
                pending.append(sample)
        # idle: the watermark is past all that came, and by more than a trial may pause
        idle = last is not None and not later and passed - last > self.idle
        window, more = close(window, pending, *self.bounds, self.interval, idle)
        done += more
        # one state that is read once and written once, as every call for a state is a message to the JVM
        taken = [(last, 0.0, 0.0, False)] if last is not None else []
        rows = [(part, *s) for part, samples in ((WAITING, later), (WINDOW, window), (TAKEN, taken)) for s in samples]
        if rows:
            self.samples.put(rows)
        else:
            self.samples.clear()
        # again when the watermark has passed the next sample in wait, else when the trial has been idle
        if later or window:
            self.handle.registerTimer(int((later[0][0] if later else last + self.idle) * 1000) + 2)
        told = [(key[0], w[0][0], w[-1][0] + self.interval, median(s[1] for s in w), median(s[2] for s in w), len(w)) for w in done]
        return pd.DataFrame(told, columns=["key", "start_t", "end_t", "x", "y", "samples"])

    def close(self) -> None:
        pass


def fixation_stream(samples: DataFrame, spread: float, gap: float, least: float, interval: float, late: str = "1 second", idle: float = 60.0) -> DataFrame:
    """Fixations of a stream of samples (key, t in seconds since 1970, x, y, off), as they close; late is how late a sample may come.

    Samples without key, t, x or y aren't there (rows with off need no place). The session has to keep its state in RocksDB, see PROVIDER.
    """
    clean = samples.select(F.col("key").cast("long"), F.col("t").cast("double"), F.coalesce(F.col("x").cast("double"), F.when(F.col("off"), 0.0)).alias("x"), F.coalesce(F.col("y").cast("double"), F.when(F.col("off"), 0.0)).alias("y"), F.coalesce("off", F.lit(False)).alias("off")).dropna()
    timed = clean.withColumn("at", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=FixationProcessor(spread, gap, least, interval, idle), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")
