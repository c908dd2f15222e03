"""What words cost given the ones beside them, and how uncertain the next one is, from counts of words and pairs.

Costs by document are made where pairs are counted: a token is sent once to where all tokens of its word are, which is where
the pairs that begin with it are as well. Words and pairs that are more than one in SHARE of all tokens, of which
there are less than SHARE, don't meet in one task: their counts go to all tasks, and pairs that begin
with such a word are counted pair by pair. Costs of each token are made where its text is, to which counts come (parts).
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenread.operators import parts
from lumenread.operators.depths import written

#: One in so many tokens makes a word or a pair a frequent one.
SHARE = 5000
#: Words whose entropy every task knows, the most frequent ones at most.
HEAD = 200_000


def least_count(uses: DataFrame, most: int) -> int:
    """The least count such that at most so many rows of uses (one column) have it or a higher one; counts above 100,000 are taken as one."""
    found = uses.toDF("n").groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("m")).collect()
    total, least = 0, 100_001
    for n, m in sorted(((r["n"], r["m"]) for r in found), reverse=True):
        total += m
        if total > most:
            break
        least = n
    return least


def with_counts(tokens: DataFrame, keep: list[str], share: int = SHARE) -> tuple[DataFrame, int]:
    """keep's columns of tokens (a: the word, b: the next one or null), words and pairs (how often the token's word and it with the next one occur; null for the last), and the number of words."""
    uses = written(tokens.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    vocabulary, total = uses.agg(F.count(F.lit(1)), F.sum("n")).first()
    often = uses.filter(F.col("n") * share > (total or 0))
    told = tokens.join(F.broadcast(often.select("a", F.col("n").alias("n_a"))), "a", "left").join(F.broadcast(often.select(F.col("a").alias("b"), F.col("n").alias("n_b"))), "b", "left")
    both = told.filter("n_a is not null and n_b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab")).filter(F.col("n_ab") * share > (total or 0))
    told = told.join(F.broadcast(written(both)), ["a", "b"], "left").withColumn("known", F.expr("n_a is not null and (b is null or n_ab is not null)"))
    known = told.filter("known").select(*keep, F.col("n_a").alias("words"), F.col("n_ab").alias("pairs"))
    # one exchange and one sort serve both counts; the hash comes first in the sort, as numbers are told apart without reading the words
    met = told.filter("not known").select(*keep, "a", "b", "n_a", F.when(F.col("n_a").isNotNull(), F.col("b")).alias("apart")).repartition("a", "apart").withColumn("hash", F.xxhash64("a", "apart"))
    met = met.sortWithinPartitions("hash", "a", "apart", "b")
    all_, same = F.count(F.lit(1)).over(Window.partitionBy("hash", "a", "apart")), F.count(F.lit(1)).over(Window.partitionBy("hash", "a", "apart", "b"))
    rest = met.select(*keep, F.coalesce("n_a", all_).alias("words"), F.when(F.col("b").isNotNull(), same).alias("pairs"))
    return known.unionByName(rest), vocabulary


def surprisals(frames: Mapping[str, DataFrame], share: int = SHARE) -> DataFrame:
    """doc_id, n_words and the mean, largest and total surprisal of its words given the ones before; a first word costs nothing.

    A word's cost is made where the word before it is counted, and goes to its document from there.
    """
    tokens, vocabulary = with_counts(frames["seq"].select("doc_id", F.col("word").alias("a"), F.col("next").alias("b")), ["doc_id"], share)
    cost = F.coalesce(-F.log((F.col("pairs") + F.lit(1.0)) / (F.col("words") + vocabulary)), F.lit(0.0))
    told = tokens.select("doc_id", cost.alias("h")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.sum("h").alias("h"), F.max("h").alias("most"))
    return told.select("doc_id", "n_words", F.round(F.col("h") / F.col("n_words"), 6).alias("mean_surprisal"), F.round(F.greatest("most", F.lit(0.0)), 6).alias("max_surprisal"), F.round("h", 4).alias("sum_surprisal"))


def falls(frames: Mapping[str, DataFrame], head: int = HEAD) -> DataFrame:
    """doc_id, n (its words) and by how much the entropy of the next word falls at them, summed up.

    Pairs are counted once; entropies are a row a word. Those of the most frequent words go to all tasks, which sum up
    what they know by document; the others are joined by the two words of a pair.
    """
    seq = frames["seq"]
    pairs = seq.groupBy(F.col("word").alias("a"), F.col("next").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    followed = F.when(F.col("b").isNotNull(), F.col("n"))  # a word's last one of a text has no follower
    sums = pairs.groupBy("a").agg(F.sum("n").alias("uses"), F.sum(followed).alias("t"), F.sum(followed * F.log(followed)).alias("s"), F.count("b").alias("followers"))
    words = written(sums.select("a", "uses", F.when(F.col("followers") == 1, 0.0).otherwise(F.log("t") - F.col("s") / F.col("t")).alias("h")))
    vocabulary, least = words.count(), least_count(words.select("uses"), head)
    if not vocabulary:
        return seq.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("reduction"))
    known = words.select("a", "uses", F.coalesce("h", F.lit(math.log(vocabulary))).alias("h"))
    often = known.filter(F.col("uses") >= least)
    h_a, h_b = (lambda of: of.select(F.col("a").alias("prev"), F.col("h").alias("h_a"))), (lambda of: of.select(F.col("a").alias("word"), F.col("h").alias("h_b")))
    fall = F.when(F.col("prev").isNotNull(), F.greatest(F.lit(0.0), F.col("h_a") - F.col("h_b")))
    told = seq.select("doc_id", "prev", "word").join(F.broadcast(h_a(often)), "prev", "left").join(F.broadcast(h_b(often)), "word", "left")
    open_ = F.expr("prev is not null and (h_a is null or h_b is null)")
    # read once: a document's known words become one row, the others a row a pair
    told = written(told.groupBy("doc_id", F.when(open_, F.col("prev")).alias("prev"), F.when(open_, F.col("word")).alias("word")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~open_, F.coalesce(fall, F.lit(0.0)))).alias("fall")))
    rest = told.filter("prev is not null").select("doc_id", "n", "prev", "word").join(h_a(known), "prev").join(h_b(known), "word").select("doc_id", "n", (F.col("n") * fall).alias("fall"))
    parts = told.filter("prev is null").select("doc_id", "n", "fall").unionByName(rest)
    return parts.groupBy("doc_id").agg(F.sum("n").alias("n"), F.round(F.sum("fall"), 4).alias("reduction"))


def transitions(frames: Mapping[str, DataFrame], share: int = SHARE, part: int = parts.PART, piece: int = parts.PIECE) -> DataFrame:
    """doc_id, pos, fwd and bwd of every token of documents: add-one smoothed log probabilities.

    Tokens stay with their texts (see parts), where no word is too frequent, so share, which told frequent words apart, changes nothing.
    """
    return parts.costs(frames["documents"], part, piece)
