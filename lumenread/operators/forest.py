"""Extremely randomised trees for regression, grown level by level over all rows.

A level takes two passes, each one aggregation: the first gives every open node's rows, sums and the
range of each feature, from which a threshold is drawn for each feature; the second gives what each
threshold would send to the left. Tasks route their rows through the trees so far and sum up in
numpy, so what is shuffled and what the driver gets grows with the nodes and features, not with
the rows; trees, depth and so the nodes are parameters.

Rules: all rows grow each tree. A node is split if some feature's threshold leaves least rows on
both sides; of these splits the one with the least squared error in all targets together wins, the
first feature of equals. Thresholds are low + u (high - low), u from the md5 of seed, forest, tree, node and
feature (the documented random stream); x <= threshold goes left. Nodes are numbered 1, 2 n, 2 n + 1.
A forest may leave out the rows of one group, so all folds grow together. Rows with a null or
non-finite feature or target are left out; a forest without rows predicts null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenread.functions.dialect import DUCK
from lumenread.sources import tables

#: Nodes that all trees together may have; the model travels with the plan.
MOST_NODES = 4_000_000


def uniform(*parts: object) -> float:
    """A number in [0, 1) from the md5 of its parts."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


@dataclass
class Forest:
    """Splits and leaves of trees; held[f] is the group that forest f leaves out (null: none)."""

    held: list
    trees: int
    depth: int
    features: int
    targets: int
    feature: np.ndarray = field(init=False)
    threshold: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        shape = (len(self.held) * self.trees, 1 << self.depth + 1)
        if shape[0] * shape[1] > MOST_NODES:
            raise ValueError(f"more than {MOST_NODES} nodes; take fewer trees or levels")
        self.feature, self.threshold, self.value = np.full(shape, -1, np.int32), np.zeros(shape), np.full((*shape, self.targets), np.nan)

    def route(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The node of a tree that each row is in."""
        at = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            split = self.feature[tree, at]
            on = np.flatnonzero(split >= 0)
            if not len(on):
                break
            at[on] = 2 * at[on] + (x[on, split[on]] > self.threshold[tree, at[on]])
        return at

    def predict(self, x: np.ndarray, forest: int) -> np.ndarray:
        """Mean of the trees' leaves."""
        own = range(forest * self.trees, (forest + 1) * self.trees)
        return np.mean([self.value[t, self.route(t, x)] for t in own], axis=0)


def _numbers(frame: pd.DataFrame, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y = (np.stack(frame[c].to_numpy()).astype(float) for c in ("x", "y"))
    fit = np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
    return x[fit], y[fit], frame["g"].to_numpy()[fit]


def _level(rows: DataFrame, forest: Forest, open_: dict[tuple[int, int], int], thresholds: np.ndarray | None) -> pd.DataFrame:
    """By open node and feature: rows, range and sums of the targets (of those left of the thresholds, if given)."""
    sums = [f"s{o}" for o in range(forest.targets)]
    dense = np.full(forest.feature.shape, -1, np.int64)
    for (tree, node), k in open_.items():
        dense[tree, node] = k
    size, p = len(open_), forest.features

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros((size, p), np.int64), np.zeros((size, p, forest.targets))
        low, high = np.full((size, p), np.inf), np.full((size, p), -np.inf)
        for frame in frames:
            x, y, groups = _numbers(frame, forest)
            for f, held in enumerate(forest.held):
                mine = np.flatnonzero(groups != held) if held is not None else np.arange(len(x))
                xs, ys = x[mine], y[mine]
                for t in range(f * forest.trees, (f + 1) * forest.trees):
                    k = dense[t, forest.route(t, xs)]
                    for j in range(p):
                        on = np.flatnonzero((k >= 0) & (xs[:, j] <= thresholds[k, j]) if thresholds is not None else k >= 0)
                        np.add.at(n[:, j], k[on], 1)
                        np.add.at(total[:, j], k[on], ys[on])
                        if thresholds is None:
                            np.minimum.at(low[:, j], k[on], xs[on, j])
                            np.maximum.at(high[:, j], k[on], xs[on, j])
        k, j = np.nonzero(n)
        yield pd.DataFrame({"k": k, "j": j, "n": n[k, j], "low": low[k, j], "high": high[k, j]} | {s: total[k, j, o] for o, s in enumerate(sums)})

    schema = ", ".join(["k long, j int, n long, low double, high double", *(f"{s} double" for s in sums)])
    parts = rows.mapInPandas(run, schema).groupBy("k", "j").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), *(F.sum(s).alias(s) for s in sums))
    return parts.toPandas()


def fit(rows: DataFrame, features: list[str], targets: list[str], group: str | None = None, held: list | None = None, trees: int = 100, depth: int = 8, least: int = 2, seed: int = 42) -> Forest:
    """A forest of trees for each group in held (without its rows), or one forest of all rows."""
    array = lambda names: F.array(*(F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in names))
    slim = rows.select(array(features).alias("x"), array(targets).alias("y"), (F.col(group) if group else F.lit(0)).alias("g"))
    forest = Forest(held if held is not None else [None], trees, depth, len(features), len(targets))
    sums = [f"s{o}" for o in range(len(targets))]
    nodes = [(t, 1) for t in range(len(forest.held) * trees)]
    for level in range(depth + 1):
        open_ = {node: k for k, node in enumerate(nodes)}
        if not open_:
            break
        size, p = len(open_), len(features)
        n, total, low, high = np.zeros((size, p), np.int64), np.zeros((size, p, len(targets))), np.zeros((size, p)), np.zeros((size, p))
        found = _level(slim, forest, open_, None)
        at = found["k"].to_numpy(int), found["j"].to_numpy(int)
        n[at], low[at], high[at], total[at] = found["n"], found["low"], found["high"], found[sums].to_numpy()
        for (t, node), k in open_.items():
            if n[k, 0]:
                forest.value[t, node] = total[k, 0] / n[k, 0]
        if level == depth:
            break
        u = np.array([[uniform(seed, forest.held[t // trees] if group and held is not None else "", t % trees, node, j) for j in range(p)] for t, node in nodes]).reshape(size, p)
        thresholds = low + u * (high - low)
        found = _level(slim, forest, open_, thresholds)
        nl, left = np.zeros((size, p), np.int64), np.zeros_like(total)
        at = found["k"].to_numpy(int), found["j"].to_numpy(int)
        nl[at], left[at] = found["n"], found[sums].to_numpy()
        nr, right = n - nl, total - left
        fits = (nl >= least) & (nr >= least) & (high > low)
        gain = (left**2).sum(axis=2) / np.maximum(nl, 1) + (right**2).sum(axis=2) / np.maximum(nr, 1)
        best = np.where(fits, np.round(gain, 6), -np.inf).argmax(axis=1)
        nodes = []
        for (t, node), k in open_.items():
            if fits[k].any():
                forest.feature[t, node], forest.threshold[t, node] = best[k], thresholds[k, best[k]]
                nodes += [(t, 2 * node), (t, 2 * node + 1)]
    return forest


def predicted(rows: DataFrame, forest: Forest, features: list[str], group: str | None = None) -> DataFrame:
    """rows with prediction, an array of the targets: each row by the forest that left out its group, or by the only one."""
    which = {held: f for f, held in enumerate(forest.held)}

    @F.pandas_udf("array<double>")
    def told(x: pd.Series, g: pd.Series) -> pd.Series:
        out: list = [None] * len(x)
        numbers = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, forest.features))
        for value in g.unique():
            f = which.get(value, 0 if group is None else None)
            on = np.flatnonzero((g == value).to_numpy() & np.isfinite(numbers).all(axis=1))
            if f is not None and len(on):
                for i, row in zip(on, forest.predict(numbers[on], f), strict=True):
                    out[i] = row.tolist() if np.isfinite(row).all() else None
        return pd.Series(out)

    array = F.array(*(F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in features))
    return rows.withColumn("prediction", told(array, F.col(group) if group else F.lit(0)))


# ---------------------------------------------------------------- query: leave one label of the embeddings out

FEATURES, TARGETS, TREES, DEPTH, LEAST, SEED = [f"x{k}" for k in range(2, 8)], ["x0", "x1"], 6, 4, 2, 42


def extra_trees_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors on each label's rows of trees that were grown on all other labels: rows, mean and median length."""
    rows = tables.read(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(8)))
    labels = sorted(r["label"] for r in rows.select("label").distinct().collect())  # few by what the table is
    forest = fit(rows, FEATURES, TARGETS, "label", labels, TREES, DEPTH, LEAST, SEED)
    found = predicted(rows, forest, FEATURES, "label")
    error = F.sqrt(F.pow(F.col("prediction")[0] - F.col("x0"), 2) + F.pow(F.col("prediction")[1] - F.col("x1"), 2))
    return found.withColumn("error", error).groupBy("label").agg(F.count("error").alias("n"), F.round(F.avg("error"), 6).alias("mean_error"), F.round(F.percentile("error", 0.5), 6).alias("median_error"))


def _level_sql(level: int) -> str:
    """A level over rows of (forest, tree, vec_id, node): ranges, thresholds, what is left of them, the best split, the next nodes."""
    a, x = f"a{level}", "(m.forest, m.tree, m.node, m.j)"
    u = DUCK.uniform(str(SEED), "forest", "tree", "node", "j - 2")
    return f"""r{level} as (select forest, tree, node, j, min(v) as low, max(v) as high, count(*) as n, sum(y0) as t0, sum(y1) as t1 from {a} join long_ using (vec_id) group by all),
h{level} as (select *, low + {u} * (high - low) as cut from r{level}),
l{level} as (select m.forest, m.tree, m.node, m.j, m.cut, m.low, m.high, any_value(m.n) as n, any_value(m.t0) as t0, any_value(m.t1) as t1, count(case when v <= cut then 1 end) as nl, sum(case when v <= cut then y0 else 0 end) as s0, sum(case when v <= cut then y1 else 0 end) as s1
    from {a} a join long_ l using (vec_id) join h{level} m on m.forest = a.forest and m.tree = a.tree and m.node = a.node and m.j = l.j group by {x[1:-1]}, m.cut, m.low, m.high),
b{level} as materialized (select forest, tree, node, arg_min(struct_pack(j := j, cut := cut), (-round((s0 * s0 + s1 * s1) / nl + ((t0 - s0) * (t0 - s0) + (t1 - s1) * (t1 - s1)) / (n - nl), 6), j)) as s from l{level} where nl >= {LEAST} and n - nl >= {LEAST} and high > low group by forest, tree, node),
a{level + 1} as materialized (select a.forest, a.tree, a.vec_id, 2 * a.node + (l.v > b.s.cut)::int as node from {a} a join b{level} b using (forest, tree, node) join long_ l on l.vec_id = a.vec_id and l.j = b.s.j)"""


#: Written apart: rows beside trees, a relation for each level; a row to be told goes down by the same splits.
EXTRA_TREES_SQL = f"""with w as (select vec_id, label, list_transform(embedding, lambda e: cast(e as double)) as e from embeddings), pts as (select vec_id, label, e[1] as y0, e[2] as y1 from w),
long_ as materialized (select vec_id, label, y0, y1, j, e[j + 1] as v from (select w.*, p.y0, p.y1 from w join pts p using (vec_id)) cross join (select unnest(range(2, 8)) as j)),
forests as (select forest, tree from (select distinct label as forest from pts) cross join (select unnest(range({TREES})) as tree)),
a0 as materialized (select forest, tree, vec_id, 1 as node from forests cross join pts where label <> forest), {", ".join(_level_sql(k) for k in range(DEPTH))},
grown as (select forest, tree, node, avg(y0) as m0, avg(y1) as m1 from ({" union all ".join(f"select * from a{k}" for k in range(DEPTH + 1))}) q join pts using (vec_id) group by forest, tree, node),
splits as (select *, 1 as one from ({" union all ".join(f"select * from b{k}" for k in range(DEPTH))}) q), d0 as (select forest, tree, vec_id, 1 as node from forests join pts on label = forest),
{", ".join(f"d{k + 1} as materialized (select d.forest, d.tree, d.vec_id, case when b.one is null then d.node else 2 * d.node + (l.v > b.s.cut)::int end as node from d{k} d left join splits b using (forest, tree, node) left join long_ l on l.vec_id = d.vec_id and l.j = b.s.j)" for k in range(DEPTH))},
told as (select vec_id, avg(m0) as p0, avg(m1) as p1 from d{DEPTH} join grown using (forest, tree, node) group by vec_id), errors as (select label, sqrt(pow(p0 - y0, 2) + pow(p1 - y1, 2)) as error from told join pts using (vec_id))
select label, count(*) as n, round(avg(error), 6) as mean_error, round(quantile_cont(error, 0.5), 6) as median_error from errors group by label"""
QUERIES = {"extra_trees_cv": extra_trees_cv}
ORACLE = {"extra_trees_cv": EXTRA_TREES_SQL}
