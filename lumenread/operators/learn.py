"""Linear models of reading times and pair rankers, with folds that keep groups together."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenread.functions.dialect import SPARK


def moments(rows: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """Sums of products of the features, the target and 1, by group: all that a linear fit needs of the rows."""
    names = [*features, target]
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    sums = [F.sum(a * b) for i, a in enumerate(terms) for b in terms[i:]]
    return rows.dropna(subset=names).groupBy(*by).agg(F.array(*sums).alias("moments"))


def matrix(flat: Sequence[float]) -> np.ndarray:
    n = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = flat
    return out + np.triu(out, 1).T


def ridge(m: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and weights with the weights, not the intercept, held to alpha; m: moments with the target last."""
    n, means = m[0, 0], m[0, 1:] / m[0, 0]
    centred = m[1:, 1:] - n * np.outer(means, means)
    weights = np.linalg.solve(centred[:-1, :-1] + alpha * np.eye(len(means) - 1), centred[:-1, -1])
    return float(means[-1] - means[:-1] @ weights), weights


def r_squared(m: np.ndarray, intercept: float, weights: np.ndarray) -> float:
    """1 - SSE / SST about the mean of the rows that m sums up."""
    w = np.concatenate([[-intercept], -weights, [1.0]])
    return float(1 - (w @ m @ w) / (m[-1, -1] - m[0, -1] ** 2 / m[0, 0]))


def crc_fold(key: Column, folds: int) -> Column:
    """The fold of a group by its key's checksum: all rows of a key are in one."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)).cast("int")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a text's UTF-8 bytes."""
    codes = F.transform(F.sequence(F.lit(0), F.octet_length(text)), lambda i: F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), i, 1)), 16, 10).cast("long"))
    step = lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(1 << 32))
    return F.aggregate(F.slice(codes, 2, F.octet_length(text)), F.lit(2166136261).cast("long"), step)


def fold(key: str, folds: int) -> Column:
    """The fold of a group by the documented random stream: all rows of a key are in one."""
    return F.floor(F.expr(SPARK.uniform("'fold'", key)) * folds).cast("int")


def group_cv(rows: DataFrame, key: str, features: Sequence[str], target: str, alphas: Sequence[float], folds: int = 10) -> pd.DataFrame:
    """R squared of each fold and alpha, fitted on the other folds, from one pass over the rows."""
    parts = {r["fold"]: matrix(r["moments"]) for r in moments(rows.withColumn("fold", fold(key, folds)), features, target, ["fold"]).collect()}
    whole = sum(parts.values())
    out = [(k, a, int(m[0, 0]), r_squared(m, *ridge(whole - m, a))) for k, m in sorted(parts.items()) for a in alphas]
    return pd.DataFrame(out, columns=["fold", "alpha", "n", "r2"])


def shuffled_group_cv(rows: DataFrame, key: str, features: Sequence[str], target: str, alpha: float, splits: int = 30, share: float = 0.2, shards: int = 200) -> list[tuple[int, int, float]]:
    """Test rows and R squared of each of several random splits that keep groups together, from one pass over the rows.

    Groups fall into shards, and a split draws shards for its test.
    """
    parts = {r["fold"]: matrix(r["moments"]) for r in moments(rows.withColumn("fold", fold(key, shards)), features, target, ["fold"]).collect()}
    out = []
    for split in range(1, splits + 1):
        tested = [m for k, m in parts.items() if stream("split", split, k) < share]
        if tested and len(tested) < len(parts):
            test = sum(tested)
            out.append((split, int(test[0, 0]), r_squared(test, *ridge(sum(parts.values()) - test, alpha))))
    return out


def stream(*parts: object) -> float:
    """The documented random stream on the driver."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def best_alpha(train: np.ndarray, dev: np.ndarray, alphas: Sequence[float]) -> float:
    """The alpha whose fit on the training moments explains the development moments best; the smallest of equal ones."""
    return max(sorted(alphas), key=lambda a: round(r_squared(dev, *ridge(train, a)), 12))


def logistic(rows: DataFrame, features: Sequence[str], label: str, penalty: float = 1.0, intercept: bool = True, steps: int = 12) -> np.ndarray:
    """Weights (intercept first) of a penalised logistic fit by Newton's method; each step is one aggregation."""
    names = list(features)
    width = len(names) + intercept
    x = [F.lit(1.0)] * intercept + [F.col(c).cast("double") for c in names]
    weights = np.zeros(width)
    hold = penalty * np.diag([0.0] * intercept + [1.0] * len(names))
    for _ in range(steps):
        z = sum((F.lit(float(w)) * c for w, c in zip(weights, x, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        slopes = [F.sum((F.col(label) - p) * c) for c in x]
        bends = [F.sum(p * (1 - p) * a * b) for i, a in enumerate(x) for b in x[i:]]
        row = rows.agg(F.array(*slopes).alias("g"), F.array(*bends).alias("h")).first()
        step = np.linalg.solve(matrix(row["h"]) + hold, np.array(row["g"]) - hold @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-10:
            break
    return weights


def pair_ranker(pairs: DataFrame, features: Sequence[str], label: str) -> tuple[np.ndarray, np.ndarray]:
    """Weights and scales of a ranker without intercept over feature differences, scaled but not centred."""
    row = pairs.agg(*[F.stddev_pop(c).alias(c) for c in features]).first()
    scales = np.array([row[c] for c in features]) + 1e-9
    scaled = pairs.select(F.col(label).alias("y"), *[(F.col(c) / F.lit(float(s))).alias(c) for c, s in zip(features, scales, strict=True)])
    return logistic(scaled, features, "y", intercept=False), scales


def vectors_of_pairs(pairs: DataFrame, left: str, right: str, label_first: str, slots: int = 60, sums: tuple[str, str] | None = None) -> DataFrame:
    """Both orders of each pair: two arrays of predicted times, cut or padded with 0 to slots, then both lengths, both means
    and, if asked for, both surprisal sums; label 1 if the harder is first. A pair typed by hand is a frame of one row."""

    def padded(c: str) -> Column:
        return F.slice(F.concat(F.col(c), F.array_repeat(F.lit(0.0), slots)), 1, slots)

    def size(c: str) -> Column:
        return F.size(c).cast("double")

    def mean(c: str) -> Column:
        return F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)).otherwise(0.0)

    def vector(one: str, two: str, extra: tuple[str, ...]) -> Column:
        return F.concat(padded(one), padded(two), F.array(size(one), size(two), mean(one), mean(two), *[F.col(c).cast("double") for c in extra]))

    first = pairs.select(vector(left, right, sums or ()).alias("vector"), F.col(label_first).cast("int").alias("label"))
    second = pairs.select(vector(right, left, tuple(reversed(sums or ()))).alias("vector"), (1 - F.col(label_first).cast("int")).alias("label"))
    return first.unionByName(second)


def squared_hinge(rows: DataFrame, features: Sequence[str], label: str, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (intercept first, held like the others) of a linear support vector classifier with squared hinge loss.

    Newton's method on the rows inside the margin; each step is one aggregation, and it ends when
    the same rows are inside again.
    """
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    y = 2 * F.col(label) - 1
    weights = np.zeros(len(x))
    for _ in range(steps):
        z = sum((F.lit(float(w)) * c for w, c in zip(weights, x, strict=True)), F.lit(0.0))
        inside = F.when(y * z < 1, 1.0).otherwise(0.0)
        row = rows.agg(F.array(*[F.sum(inside * y * c) for c in x]).alias("g"), F.array(*[F.sum(inside * a * b) for i, a in enumerate(x) for b in x[i:]]).alias("h")).first()
        found = np.linalg.solve(2 * penalty * matrix(row["h"]) + np.eye(len(x)), 2 * penalty * np.array(row["g"]))
        done = np.abs(found - weights).max() < 1e-12
        weights = found
        if done:
            break
    return weights


def squares(rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """rows with all products of two features beside the features themselves."""
    names = list(features)
    more = {f"{a}_{b}": F.col(a) * F.col(b) for i, a in enumerate(names) for b in names[i:]}
    return rows.select("*", *[c.alias(n) for n, c in more.items()]), [*names, *more]


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int = 10) -> DataFrame:
    """rows with a fold that has its share of every label, by the random stream within the label."""
    return rows.withColumn("fold", F.floor(F.expr(SPARK.uniform("'strata'", label, key)) * folds).cast("int"))


def logistic_folds(rows: DataFrame, features: Sequence[str], label: str, fold_: str = "fold", penalty: float = 1.0, steps: int = 12) -> dict[int, np.ndarray]:
    """Weights (intercept first) of a penalised logistic fit without each fold, all fits in one pass a step.

    A task adds up each fit's gradient and second derivatives over its rows; no row is copied. Rows with a null feature or label are left out.
    """
    ids = sorted(r[0] for r in rows.select(fold_).distinct().collect())  # a row a fold
    weights = {k: np.zeros(len(features) + 1) for k in ids}
    hold = penalty * np.diag([0.0] + [1.0] * len(features))
    slim = rows.select(F.col(fold_).alias("fold"), F.col(label).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features))).dropna()
    size = len(features) + 1

    def sums(fits: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, h = np.zeros((len(ids), size)), np.zeros((len(ids), size, size))
            for frame in frames:
                x = np.column_stack([np.ones(len(frame)), *(frame[f"x{i}"] for i in range(size - 1))])
                y, fold_of = frame["y"].to_numpy(), frame["fold"].to_numpy()
                for k, held in enumerate(ids):
                    own = fold_of != held
                    p = 1 / (1 + np.exp(-x[own] @ fits[k]))
                    g[k] += x[own].T @ (y[own] - p)
                    h[k] += (x[own] * (p * (1 - p))[:, None]).T @ x[own]
            flat = np.concatenate([g, h.reshape(len(ids), -1)], axis=1)
            yield pd.DataFrame({"at": np.arange(flat.size), "v": flat.ravel()})

        return run

    for _ in range(steps):
        found = slim.mapInPandas(sums(np.array([weights[k] for k in ids])), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # numbers of the fits
        flat = np.zeros((len(ids), size + size * size))
        flat.ravel()[found["at"].to_numpy()] = found["v"].to_numpy()
        most = 0.0
        for k, row in zip(ids, flat, strict=True):
            step = np.linalg.solve(row[size:].reshape(size, size) + hold, row[:size] - hold @ weights[k])
            weights[k] = weights[k] + step
            most = max(most, float(np.abs(step).max()))
        if most < 1e-10:
            break
    return weights


def fold_scores(rows: DataFrame, features: Sequence[str], label: str, weights: dict[int, np.ndarray], fold_: str = "fold") -> DataFrame:
    """n and accuracy of each fold under the fit without it."""
    told = F.create_map(*[c for k, w in weights.items() for c in (F.lit(k), F.array(*[F.lit(float(v)) for v in w]))])
    z = sum((told[F.col(fold_)][i] * c for i, c in enumerate([F.lit(1.0), *[F.col(c).cast("double") for c in features]])), F.lit(0.0))
    return rows.groupBy(fold_).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when((z > 0) == (F.col(label) == 1), 1.0).otherwise(0.0)), 6).alias("accuracy"))


def save_model(spark: SparkSession, path: str, kind: str, terms: dict[str, float], scales: dict[str, float] | None = None) -> None:
    """A linear model as a small table: kind, term, weight, scale."""
    rows = [(kind, t, float(w), float((scales or {}).get(t, 1.0))) for t, w in terms.items()]
    spark.createDataFrame(rows, "kind string, term string, weight double, scale double").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[str, dict[str, float], dict[str, float]]:
    rows = spark.read.parquet(path).collect()  # a row a term
    return rows[0]["kind"], {r["term"]: r["weight"] for r in rows}, {r["term"]: r["scale"] for r in rows}


def linear_score(terms: dict[str, float], scales: dict[str, float] | None = None) -> Column:
    """A saved model's value: the intercept and each term's weight times its column over its scale; null counts as 0."""
    parts = [F.lit(w) if t == "intercept" else F.lit(w) * F.coalesce(F.col(t), F.lit(0.0)) / F.lit((scales or {}).get(t, 1.0)) for t, w in terms.items()]
    return sum(parts, F.lit(0.0))


def varying(rows: DataFrame, features: Sequence[str]) -> list[str]:
    """The features with some value and some spread."""
    row = rows.agg(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(c) for c in features]).first()
    return [c for c in features if row[c] > 0]
