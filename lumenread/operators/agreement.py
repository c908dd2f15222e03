"""Mean agreement of each reader with all later ones, without a row for every two of them.

Spearman's coefficient of two readers is the product of their ranks over the words that both read,
centred and of length one. These ranks depend on a reader and that set of words only, so the sum of a
reader's coefficients with all later readers who read one set of words is the product of its own ranks
with the sum of theirs. Readers are put together by the set of words they read, ranks are taken once
for each set that two such sets share, and sums over later readers are running sums.

Rows grow with readers times sets of words. Sets are few where words are few (2 of 8 words at sf0.1);
if every reader has a set of its own, there are as many rows as pairs.

Defined results: ties share their mean rank, null times rank last; rows without reader or word don't
count; two readers need LEAST words, and a pair of which one has all ranks equal has no coefficient.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lumenread.operators.depths import written

#: Words that two readers have to share, and numeric reader ids of a block that is summed up on its own.
LEAST, BLOCK = 3, 4096


def unit_ranks(times: np.ndarray, null: np.ndarray) -> list[float] | None:
    """Ranks of times, centred and of length one; None if all are equal."""
    times = np.where(null, 0.0, times)
    order = np.lexsort((times, null))
    own, gone = times[order], null[order]
    same = ((own[1:] == own[:-1]) | (np.isnan(own[1:]) & np.isnan(own[:-1]))) & (gone[1:] == gone[:-1])
    group = np.concatenate([[0], np.cumsum(~same)])
    if not group[-1]:
        return None
    mean = np.bincount(group, np.arange(len(own))) / np.bincount(group)
    ranks = np.empty(len(own))
    ranks[order] = mean[group] - (len(own) - 1) / 2
    return (ranks / np.sqrt((ranks * ranks).sum())).tolist()


def mean_agreement(frames: Mapping[str, DataFrame]) -> DataFrame:
    """user_id, pairs, mean_r and mean_overlap of readers with later ones, from fix (user_id, w, d)."""

    @F.pandas_udf("array<double>")
    def ranked(times: pd.Series, null: pd.Series) -> pd.Series:
        return pd.Series([unit_ranks(np.asarray(t, float), np.asarray(n, bool)) for t, n in zip(times, null, strict=True)], dtype=object)

    totals = frames["fix"].filter("user_id is not null and w is not null").groupBy("user_id", "w").agg(F.sum("d").alias("td"))
    own = F.sort_array(F.collect_list(F.struct("w", "td")))
    readers = totals.groupBy("user_id").agg(own.alias("own")).select("user_id", F.col("own.w").alias("words"), F.col("own.td").alias("times")).filter(F.size("words") >= LEAST)
    readers = written(readers)
    sets = written(readers.select("words").distinct().select("words", F.monotonically_increasing_id().alias("id")))
    first, second = sets.select(F.col("id").alias("p"), F.col("words").alias("p_words")), sets.select(F.col("id").alias("q"), F.col("words").alias("q_words"))
    both = first.crossJoin(second).select("p", "q", F.sort_array(F.array_intersect("p_words", "q_words")).alias("shared")).filter(F.size("shared") >= LEAST)
    met = written(both.groupBy("p", "shared").agg(F.collect_list("q").alias("qs")).select("p", "shared", "qs", F.monotonically_increasing_id().alias("meeting")))
    # each reader's ranks over every set of words that is shared with others
    shared = written(met.select("p", "shared").unionByName(met.select(F.explode("qs").alias("p"), "shared")).distinct())
    place = F.transform("shared", lambda w: F.array_position("words", w).cast("int"))
    marked = readers.join(sets, "words").join(shared.withColumnRenamed("p", "id"), "id").withColumn("picked", F.transform(place, lambda k: F.element_at("times", k)))
    ranks = marked.select("user_id", "id", "shared", ranked("picked", F.transform("picked", F.isnull)).alias("ranks"))
    told = F.concat(F.array(F.lit(1.0), F.when(F.col("ranks").isNull(), 0.0).otherwise(1.0)), F.coalesce("ranks", F.expr("cast(array() as array<double>)")))
    block = F.floor(F.col("user_id") / BLOCK) if isinstance(readers.schema["user_id"].dataType, NumericType) else F.lit(0)
    vectors = written(ranks.select("user_id", "id", "shared", block.alias("block"), told.alias("told")))
    takers = vectors.join(met.select(F.col("p").alias("id"), "shared", "meeting"), ["id", "shared"])
    givers = vectors.join(met.select(F.explode("qs").alias("id"), "shared", "meeting"), ["id", "shared"])
    size = F.size("shared").alias("size")
    rows = givers.select("meeting", "block", "user_id", size, F.posexplode("told").alias("place", "give")).withColumn("take", F.lit(None).cast("double")).unionByName(
        takers.select("meeting", "block", "user_id", size, F.posexplode("told").alias("place", "take")).withColumn("give", F.lit(0.0)))
    one = rows.groupBy("meeting", "place", "block", "user_id", "size").agg(F.sum("give").alias("give"), F.max("take").alias("take"))
    one = written(one)
    # sums over later readers: those of the same block, and the blocks after it
    later = Window.partitionBy("meeting", "place", "block").orderBy(F.desc("user_id")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = one.groupBy("meeting", "place", "block").agg(F.sum("give").alias("all"))
    beyond = blocks.select("meeting", "place", "block", F.coalesce(F.sum("all").over(Window.partitionBy("meeting", "place").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("beyond"))
    sums = one.withColumn("near", F.coalesce(F.sum("give").over(later), F.lit(0.0))).join(beyond, ["meeting", "place", "block"]).filter("take is not null").withColumn("met", F.col("near") + F.col("beyond"))
    of = lambda where, value: F.sum(F.when(where, value).otherwise(0.0))
    found = sums.groupBy("user_id").agg(
        of(F.col("place") == 0, F.col("met")).alias("pairs"), of(F.col("place") == 0, F.col("met") * F.col("size")).alias("overlap"),
        of(F.col("place") == 1, F.col("met") * F.col("take")).alias("valid"), of(F.col("place") > 1, F.col("met") * F.col("take")).alias("r"))
    return found.filter("pairs > 0").select("user_id", F.col("pairs").cast("long").alias("pairs"), F.when(F.col("valid") > 0, F.round(F.col("r") / F.col("valid"), 6)).alias("mean_r"), F.round(F.col("overlap") / F.col("pairs"), 6).alias("mean_overlap"))
