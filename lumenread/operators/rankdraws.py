"""Spearman's coefficient over resampled units, with ranks taken anew in every draw.

No row is copied for its draws: a unit carries the counts of all its draws as one array. Values are cut into
bins at quantiles, and the counts of each bin and draw, a small table, say how many units come before a bin.
Ranks inside a bin are cumulative sums over all draws at once. A value as frequent as a bin has
a bin of its own, whose ranks its counts tell, so that ties needn't meet in one task.

Bins have odd numbers if they are of one value. Ranks are doubled and taken from their mean, so they are whole numbers.
Counts are those of resample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenread.operators.depths import written
from lumenread.operators.resample import counts

#: Units of a bin, and bins of a value at most.
SHARE, MOST_BINS = 10_000, 1024
#: Units of a task that draws.
DRAWN_AT_ONCE = 2000


def bins_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Numbers of bins in order of their values: 2 k + 1 is bound k alone, 2 k what lies below it."""
    if not len(bounds):
        return np.zeros(len(values), np.int32)
    k = np.searchsorted(bounds, values)
    return (2 * k + ((k < len(bounds)) & (bounds[np.minimum(k, len(bounds) - 1)] == values))).astype(np.int32)


def arrays(column: pa.ChunkedArray | pa.Array, kind: str, draws: int) -> np.ndarray:
    """Binaries as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, draws)


def binaries(rows: np.ndarray, kind: str) -> pa.Array:
    return pa.array([r.tobytes() for r in rows.astype(kind)], pa.binary())


def doubled_ranks(values: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Twice the mean rank of each value in each draw, a unit counting as often as it is drawn."""
    order = np.argsort(values, kind="stable")
    ordered, upto = values[order], np.vstack([np.zeros((1, times.shape[1]), np.int64), np.cumsum(times[order], axis=0, dtype=np.int64)])
    first, last = np.searchsorted(ordered, values), np.searchsorted(ordered, values, side="right")
    return upto[first] + upto[last] + 1


def spearman_draws(units: DataFrame, seed: str, draws: int) -> DataFrame:
    """draw and rho (null where ranks don't differ) of units (key string, x and y double, without nulls)."""
    spark = units.sparkSession
    units = written(units.select("key", "x", "y"))
    n = units.count()
    parts = min(MOST_BINS, -(-n // SHARE)) or 1
    shares = [k / parts for k in range(1, parts)]
    cut = lambda c: F.percentile_approx(c, shares, max(10_000, 20 * parts))
    bounds = {c: np.unique(units.agg(cut(c).alias(c)).first()[c]) if shares and n else np.zeros(0) for c in ("x", "y")}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = [counts(seed, draws, (k,)).astype(np.uint8).tobytes() for k in batch.column("key").to_pylist()]
            x, y = batch.column("x"), batch.column("y")
            yield pa.RecordBatch.from_arrays(
                [x, y, pa.array(bins_of(x.to_numpy(), bounds["x"])), pa.array(bins_of(y.to_numpy(), bounds["y"])), pa.array(times, pa.binary())], names=["x", "y", "xbin", "ybin", "times"])

    drawn = units.repartition(max(1, -(-n // DRAWN_AT_ONCE)), "key").mapInArrow(draw, "x double, y double, xbin int, ybin int, times binary")
    drawn = written(drawn)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            times = arrays(batch.column("times"), "u1", draws)
            for c in ("x", "y"):
                found = batch.column(f"{c}bin").to_numpy()
                for b in np.unique(found).tolist():
                    sums[c, b] = sums.get((c, b), 0) + times[found == b].sum(axis=0, dtype=np.int64)
        for (c, b), total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * draws), pa.array([b] * draws, pa.int32()), pa.array(range(draws), pa.int32()), pa.array(total)], names=["of", "bin", "draw", "times"])

    table = drawn.mapInArrow(totals, "of string, bin int, draw int, times long").groupBy("of", "bin", "draw").agg(F.sum("times").alias("times")).toArrow()
    inside = {c: np.zeros((2 * len(bounds[c]) + 1, draws), np.int64) for c in ("x", "y")}  # by bin and draw
    of = table.column("of").to_numpy(zero_copy_only=False)
    for c, sums in inside.items():
        at = of == c
        sums[table.column("bin").to_numpy()[at], table.column("draw").to_numpy()[at]] = table.column("times").to_numpy()[at]
    # what is added to a doubled rank inside a bin, so that it counts from the mean of all
    before = {c: 2 * (np.cumsum(sums, axis=0) - sums) - (sums.sum(axis=0) + 1) for c, sums in inside.items()}
    shared = spark.sparkContext.broadcast((inside, before))

    def rank(group: pa.Table) -> pa.Table:
        """Doubled ranks inside a bin of x."""
        ranks = doubled_ranks(group.column("x").to_numpy(), arrays(group.column("times"), "u1", draws))
        return pa.table([group.column("y"), group.column("xbin"), group.column("ybin"), group.column("times"), binaries(ranks, "<i4")], names=["y", "xbin", "ybin", "times", "ranks"])

    def products(group: pa.Table) -> pa.Table:
        """Sums over a bin of y, or a share of it if that is one value."""
        inside, before = shared.value
        times, xbin, ybin = arrays(group.column("times"), "u1", draws), group.column("xbin").to_numpy(), group.column("ybin")[0].as_py()
        ranked = xbin % 2 == 0
        x = before["x"][xbin]
        x[~ranked] += inside["x"][xbin[~ranked]] + 1
        x[ranked] += arrays(group.column("ranks").drop_null(), "<i4", draws)
        y = before["y"][ybin] + (inside["y"][ybin] + 1 if ybin % 2 else doubled_ranks(group.column("y").to_numpy(), times))
        x, y = x.astype(float), y.astype(float)
        sums = [(times * a * b).sum(axis=0) for a, b in ((x, y), (x, x), (y, y))]
        return pa.table([pa.array(range(1, draws + 1), pa.int32()), *map(pa.array, sums)], names=["draw", "xy", "xx", "yy"])

    columns = ["y", "xbin", "ybin", "times"]
    ranked = drawn.filter("xbin % 2 = 0").select("x", *columns).repartition(parts, "xbin").groupBy("xbin").applyInArrow(rank, "y double, xbin int, ybin int, times binary, ranks binary")
    ranked = ranked.unionByName(drawn.filter("xbin % 2 = 1").select(*columns, F.lit(None).cast("binary").alias("ranks")))
    ranked = ranked.withColumn("share", F.when(F.col("ybin") % 2 == 0, 0).otherwise(F.pmod(F.xxhash64("times"), F.lit(parts))))
    sums = ranked.repartition(parts, "ybin", "share").groupBy("ybin", "share").applyInArrow(products, "draw int, xy double, xx double, yy double")
    spread = F.sqrt(F.sum("xx") * F.sum("yy"))
    return sums.groupBy("draw").agg((F.sum("xy") / F.when(spread != 0, spread)).alias("rho"))
