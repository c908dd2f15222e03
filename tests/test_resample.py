"""Resampled sums against plain Python on the same random stream."""

import hashlib

import numpy as np
import pytest

from lumenread.operators import resample


def times(seed, draw, *key):
    u = int(hashlib.md5("|".join([seed, str(draw), *map(str, key)]).encode()).hexdigest()[:8], 16) / 4294967296.0
    return sum(u >= p for p in resample.POISSON)


def test_sums_by_group_and_two_streams(spark, monkeypatch):
    monkeypatch.setattr(resample, "REMEMBERED", 3)
    rows = [(k % 2 if k % 5 else None, k, k % 3, float(k), None if k % 4 == 0 else 1.0) for k in range(40)]
    frame = spark.createDataFrame(rows, "g int, a int, b int, x double, y double").repartition(3).selectExpr("*", "1 as draw", "1 as times")
    found = {(r["g"], r["draw"]): (r["times"], r["x"], r["y"]) for r in resample.resampled(frame, [("s", ["a", "b"]), ("s", ["b"])], ["x", "y"], ["g"], 7).collect()}
    for g in (0, 1, None):
        for d in range(1, 8):
            t = [(times("s", d, a, b) * times("s", d, b), x, y) for gg, a, b, x, y in rows if gg == g]
            assert np.allclose(found[g, d], [sum(n for n, _, _ in t), sum(n * x for n, x, _ in t), sum(n * (y or 0) for n, _, y in t)])
    assert len(found) == 21


def test_mean_and_spread_of_counts():
    drawn = np.concatenate([resample.counts("m", 2000, [k]) for k in range(50)])
    assert abs(drawn.mean() - 1) < 0.02 and abs(drawn.var() - 1) < 0.03


def test_edges(spark):
    frame = spark.createDataFrame([], "a int, x double")
    assert resample.resampled(frame, [("s", ["a"])], ["x"], draws=5).count() == 0
    one = resample.resampled(spark.createDataFrame([(None, 2.0)], "a int, x double"), [("s", ["a"])], ["x"], draws=50).collect()
    assert len(one) == 50 and all(r["x"] == 2 * r["times"] for r in one) and {r["times"] for r in one} > {0.0, 1.0}
    with pytest.raises(Exception):  # noqa: B017
        resample.resampled(frame, [("s", ["missing"])], ["x"])


def test_draws_hash_seed_draw_and_key():
    """Counts by the documented stream, draw by draw; what comes before the key is made once."""
    import hashlib

    for key in (("12", "3"), ("é",), ()):
        text = lambda d: "|".join(["s", str(d), *key])  # noqa: B023, E731
        plain = [sum(int(hashlib.md5(text(d).encode()).hexdigest()[:8], 16) / 2**32 >= p for p in resample.POISSON) for d in range(1, 201)]
        assert resample.counts("s", 200, key).tolist() == plain
    assert resample.heads("s", 200) is resample.heads("s", 200)
