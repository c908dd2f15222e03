"""Depths by pointer doubling against a walk from node to node."""

import random

import pytest
from pyspark.sql import functions as F

from lumenread.operators import depths


def walked(heads):
    """Depths as a walk finds them: nodes in order, each up to one whose depth is known, a root, an unknown head or its own way."""
    known = {}
    for start in sorted(heads):
        path, at = [], start
        while at in heads and at not in known and at not in path:
            if heads[at] == 0:
                known[at] = 0
                break
            path.append(at)
            at = heads[at]
        base = known.get(at, 0)
        for k, node in enumerate(reversed(path)):
            known[node] = base + k + 1
    return known


def frame(spark, trees):
    return spark.createDataFrame([(t, n, h) for t, heads in trees.items() for n, h in heads.items()], "tree int, node long, head long")


@pytest.mark.parametrize("seed", range(3))
def test_forests_with_unknown_heads_and_circles(spark, seed):
    rng = random.Random(seed)
    trees = {t: {n: rng.choice([0, rng.randint(1, 14), rng.randint(1, 12)]) if seed else rng.randint(1, 12) for n in rng.sample(range(1, 13), rng.randint(1, 12))} for t in range(60)}
    trees[99] = {1: 2, 2: 3, 3: 1}
    trees[98] = {5: 5}
    trees[97] = {1: 9, 2: 0}
    found = {(r["tree"], r["node"]): r["depth"] for r in depths.depths(frame(spark, trees)).collect()}
    assert found == {(t, n): d for t, heads in trees.items() for n, d in walked(heads).items()}


def test_empty_null_and_repeated(spark):
    assert depths.depths(spark.createDataFrame([], "tree int, node long, head long")).count() == 0
    rows = [(None, 1, 0), (1, 1, None), (1, 2, 1), (1, 2, 1), (1, None, 1)]
    found = depths.depths(spark.createDataFrame(rows, "tree int, node long, head long").withColumn("up", F.lit(1)).withColumn("top", F.lit(1)).select("tree", "node", "head")).collect()
    assert sorted((r["tree"], r["node"], r["depth"]) for r in found if r["tree"]) == [(1, 1, 0), (1, 2, 1)]


def test_a_chain_of_many_and_many_words(spark):
    chain = spark.range(1, 10_001).select(F.lit(1).alias("tree"), F.col("id").alias("node"), (F.col("id") - 1).alias("head"))
    many = spark.range(1_200_000).select((F.col("id") % 40_000 + 2).alias("tree"), (F.floor(F.col("id") / 40_000) + 1).alias("node"), F.floor(F.col("id") / 40_000).alias("head"))
    found = depths.depths(chain.unionByName(many), 1)
    assert found.filter("tree = 1").agg(F.max("depth"), F.sum("depth")).first() == (10_000, 50_005_000)
    assert found.filter("tree > 1").agg(F.count(F.lit(1)), F.max("depth"), F.sum(F.when(F.col("depth") != F.col("node"), 1).otherwise(0))).first() == (1_200_000, 30, 0)


def test_flags(spark):
    rows = [(1, k, d) for k, d in enumerate([1, 1, 0, 0, 2, 1, 3])]
    found = depths.depth_flags(spark.createDataFrame(rows, "tree int, node int, depth int")).orderBy("node").collect()
    assert ["".join(str(r[f"h{k}"]) for k in range(1, 9)) for r in found] == ["00000000", "00000001", "10110000", "00010001", "11000100", "10100000", "11000100"]
