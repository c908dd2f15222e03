"""Extremely randomised trees against plain recursion over lists."""

import random

import numpy as np
import pytest

from lumenread.operators import forest


def plain(rows, tree, name, depth, least, seed, node=1):
    """A tree as nested tuples, by the rules as they are stated."""
    mean = [sum(y[o] for _, y in rows) / len(rows) for o in range(2)]
    best = None
    if node < 1 << depth:
        for j in range(len(rows[0][0])):
            low, high = min(x[j] for x, _ in rows), max(x[j] for x, _ in rows)
            cut = low + forest.uniform(seed, name, tree, node, j) * (high - low)
            left, right = [r for r in rows if r[0][j] <= cut], [r for r in rows if r[0][j] > cut]
            if high > low and len(left) >= least and len(right) >= least:
                gain = sum(sum(y[o] for _, y in part) ** 2 / len(part) for part in (left, right) for o in range(2))
                if best is None or round(gain, 6) > best[0]:
                    best = (round(gain, 6), j, cut, left, right)
    if best is None:
        return mean
    return best[1], best[2], plain(best[3], tree, name, depth, least, seed, 2 * node), plain(best[4], tree, name, depth, least, seed, 2 * node + 1)


def asked(tree, x):
    while len(tree) == 4:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def table(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.choice([0.0, 1.0, rng.random()]), rng.gauss(0, 1), 5.0]
        rows.append((i, i % 3, *x, x[0] + rng.gauss(0, 0.1), x[0] * x[1]))
    return rows


SCHEMA = "id int, g int, a double, b double, c double, u double, v double"


@pytest.mark.parametrize("depth,least", [(4, 1), (3, 5), (0, 1)])
def test_folds_against_plain_trees(spark, depth, least):
    rows = table(1, 120)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = forest.fit(frame, ["a", "b", "c"], ["u", "v"], "g", [0, 1, 2], trees=3, depth=depth, least=least, seed=7)
    told = {r["id"]: r["prediction"] for r in forest.predicted(frame, found, ["a", "b", "c"], "g").collect()}
    for g in range(3):
        grown = [plain([(r[2:5], r[5:]) for r in rows if r[1] != g], t, g, depth, least, 7) for t in range(3)]
        for r in rows:
            if r[1] == g:
                assert np.allclose(told[r[0]], np.mean([asked(t, r[2:5]) for t in grown], axis=0), atol=1e-9)


def test_it_learns(spark):
    rows = table(2, 400)
    frame = spark.createDataFrame(rows, SCHEMA)
    found = forest.fit(frame.filter("id % 2 = 0"), ["a", "b", "c"], ["u", "v"], trees=20, depth=8)
    told = forest.predicted(frame.filter("id % 2 = 1"), found, ["a", "b", "c"]).collect()
    error = np.mean([(r["prediction"][0] - r["u"]) ** 2 for r in told])
    assert error < 0.2 * np.var([r["u"] for r in told])


def test_nulls_and_empty_tables(spark):
    rows = [*table(3, 30), (97, 0, None, 1.0, 5.0, 1.0, 1.0), (98, 0, 1.0, float("inf"), 5.0, 1.0, 1.0), (99, None, 1.0, 1.0, 5.0, None, 1.0)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as x", "2 as k")
    found = forest.fit(frame, ["a", "b", "c"], ["u", "v"], trees=2, depth=3)
    told = {r["id"]: r["prediction"] for r in forest.predicted(frame, found, ["a", "b", "c"]).collect()}
    assert told[97] is None and told[98] is None and told[99] is not None and len(told) == 33
    none = forest.fit(frame.limit(0), ["a"], ["u"], trees=2, depth=2)
    assert {r["prediction"] for r in forest.predicted(frame, none, ["a"]).collect()} == {None}
    assert forest.predicted(frame.limit(0), found, ["a", "b", "c"]).count() == 0
    with pytest.raises(ValueError):
        forest.Forest([None], 1000, 20, 3, 2)
