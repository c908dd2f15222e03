"""Sums over resampled units: every unit draws how often it is in each resample, and only sums by draw leave a task.

A unit's count in a draw is Poisson with mean 1, from the md5 of seed, draw and key (the documented random
stream); counts of several streams multiply. A task makes all draws of a unit as one array and adds them to
its own sums, so no row is copied and what is shuffled is draws by groups. Counts end at 5, where the
Poisson's tail is 0.0006; the mean of a count is thereby 0.9994 times what it would be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distribution of the counts 0 to 4: fixed values.
POISSON = np.array([0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015])
#: Keys whose counts a task remembers from row to row.
REMEMBERED = 2000


@lru_cache(maxsize=8)
def heads(seed: str, draws: int) -> list[bytes]:
    """What is hashed before the key, for each draw."""
    return [f"{seed}|{d}".encode() for d in range(1, draws + 1)]


def counts(seed: str, draws: int, key: Sequence[object]) -> np.ndarray:
    """How often a unit is in each of the draws 1 to draws."""
    rest, md5 = "".join(f"|{k}" for k in key).encode(), hashlib.md5
    digests = b"".join([md5(head + rest).digest() for head in heads(seed, draws)])
    return np.searchsorted(POISSON, np.frombuffer(digests, ">u4")[::4] / 4294967296.0, side="right")


def resampled(units: DataFrame, streams: Sequence[tuple[str, Sequence[str]]], values: Sequence[str], by: Sequence[str] = (), draws: int = 2000) -> DataFrame:
    """by, draw, times (units drawn) and the sum of each value over the units as often as they are drawn; null values add nothing.

    streams are seeds and the key columns whose hash draws; a null key is left out of what is hashed.
    """
    keys = list(dict.fromkeys(k for _, own in streams for k in own))
    kinds = dict(units.dtypes)
    slim = units.select(*by, *(F.col(k).cast("string").alias(f"__key_{k}") for k in keys), *(F.col(v).cast("double").alias(v) for v in values))
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "draw int, times double", *(f"`{v}` double" for v in values)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        known: dict[tuple, np.ndarray] = {}
        types = None
        for batch in batches:
            types = types or [batch.schema.field(b).type for b in by]
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            numbers = np.array([[1.0] * batch.num_rows, *([0.0 if x is None else x for x in columns[v]] for v in values)]).T
            for r in range(batch.num_rows):
                times = np.ones(draws)
                for seed, own in streams:
                    key = (seed, *(columns[f"__key_{k}"][r] for k in own if columns[f"__key_{k}"][r] is not None))
                    if key not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[key] = counts(seed, draws, key[1:])
                    times = times * known[key]
                group = tuple(columns[b][r] for b in by)
                if group not in sums:
                    sums[group] = np.zeros((len(values) + 1, draws))
                sums[group] += numbers[r][:, None] * times
        for group, total in sums.items():
            arrays = [pa.array([g] * draws, t) for g, t in zip(group, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.arange(1, draws + 1), pa.int32()), *(pa.array(x, pa.float64()) for x in total)], [*by, "draw", "times", *values])

    return slim.mapInArrow(run, schema).groupBy(*by, "draw").agg(F.sum("times").alias("times"), *(F.sum(v).alias(v) for v in values))
