"""A segmenter of words, trained by description length: parts are kept if they shorten lexicon and text together.

The text is written as parts, each costing -ln of its share of all uses; the lexicon spells every part
once, each letter and the end costing -ln of its share of all letters. A round prices a part by its text
cost and its share of its own spelling (spelling / uses), finds every word type's cheapest split at
these prices (Viterbi), and counts the uses anew. It goes on until the code length stops falling, and
the shortest code is kept. At first every substring that two word types hold is in the lexicon,
used as often as it is there.

Types and their substrings are rows: prices are joined to the substrings, splits are made word by word,
uses are summed up. A round's splits are written and read back. Nothing but sums goes to the driver:
prices grow with the vocabulary, and their files look small enough to be broadcast when they are millions, so
joins with them are told to sort and merge.

Defined results: null and empty words have no parts. Words seen less than SEEN times aren't learned
from but can be split. Letters that no part covers are parts of their own, at the price of a part
used once and spelled in unknown letters. Parts are at most LONGEST letters or a whole word.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenread.operators.depths import written

#: Words that occur less often aren't learned from; letters of a part that isn't a whole word; rounds at most.
SEEN, LONGEST, ROUNDS = 2, 12, 8


def word_counts(tokens: DataFrame, articles: int | None = None, word: str = "word", article: str = "doc_id") -> DataFrame:
    """word and n of words seen at least SEEN times, of all articles or those with the smallest ids."""
    if articles is not None:
        first = tokens.select(article).distinct().orderBy(article).limit(articles)
        tokens = tokens.join(first, article, "left_semi")
    return tokens.groupBy(word).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEEN).select(F.col(word).alias("word"), "n")


def cheapest(word: str, prices: dict[str, float], worst: float) -> list[str]:
    """The parts of a word that cost least together; a letter without a price costs worst, the longer first part wins ties."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        starts = [*range(max(0, end - LONGEST), end)] if end - LONGEST <= 0 or end < len(word) else [0, *range(end - LONGEST, end)]
        best.append(min((round(best[a][0] + prices.get(word[a:end], worst if end - a == 1 else math.inf), 9), a) for a in starts))
    out, end = [], len(word)
    while end:
        out.append(word[best[end][1]: end])
        end = best[end][1]
    return out[::-1]


def substrings(word: Column) -> Column:
    """All parts that a word may have, each once."""
    size = F.length(word)
    of = lambda a: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), size - a + 1)), lambda n: F.substr(word, a, n))
    return F.when(size > 0, F.array_distinct(F.concat(F.array(word), F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), of)))))


@dataclass
class Segmenter:
    """Prices of parts as a table (part, uses, price), the price of a letter without one, and each round's code length."""

    prices: DataFrame
    worst: float
    lengths: list[float]

    def split(self, words: DataFrame, word: str = "word") -> DataFrame:
        """word and parts of the distinct words of a table, by their substrings' prices."""
        types = words.select(F.col(word).alias("word")).distinct()
        return _split(types.withColumn("n", F.lit(1).cast("long")), self.prices, self.worst).select(F.col("word").alias(word), "parts")


def _split(types: DataFrame, prices: DataFrame, worst: float) -> DataFrame:
    """word, n and parts of word types, each by the prices of its own substrings."""
    priced = types.filter("word <> ''").select("word", "n", F.explode(substrings(F.col("word"))).alias("part")).join(prices.select("part", "price").hint("merge"), "part").groupBy("word").agg(F.collect_list(F.struct("part", "price")).alias("known"))

    @F.pandas_udf("array<string>")
    def parts(words: pd.Series, known: pd.Series) -> pd.Series:
        def one(word: str | None, rows) -> list[str]:
            return cheapest(word, {r["part"]: r["price"] for r in rows} if rows is not None else {}, worst) if word else []

        return pd.Series([one(w, k) for w, k in zip(words, known, strict=True)])

    return types.join(priced.hint("merge"), "word", "left").select("word", "n", parts("word", "known").alias("parts"))


def _letters(counts: DataFrame) -> tuple[DataFrame, float, float]:
    """letter and cost, the cost of an end, and of a letter that isn't there."""
    letters = counts.select("word", F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.count()
    total = (letters.agg(F.sum("n")).first()[0] or 0) + ends + 1
    return letters.select("letter", (-F.log(F.col("n") / total)).alias("cost")), -math.log(max(ends, 1) / total), math.log(total)


def _priced(uses: DataFrame, letters: DataFrame, end: float) -> tuple[DataFrame, float]:
    """part, uses and price of parts by their uses, and the code length of lexicon and text."""
    spelled = uses.select("part", "uses", F.explode(F.split("part", "")).alias("letter")).join(F.broadcast(letters), "letter").groupBy("part", "uses").agg((F.sum("cost") + end).alias("spelling"))
    spelled = written(spelled)  # letters are an alphabet: few
    total, length = spelled.agg(F.sum("uses"), F.sum("spelling") - F.sum(F.col("uses") * F.log("uses"))).first()
    if not total:
        return spelled.select("part", "uses", F.lit(0.0).alias("price")), 0.0
    return spelled.select("part", "uses", (-F.log(F.col("uses") / F.lit(float(total))) + F.col("spelling") / F.col("uses")).alias("price")), length + total * math.log(total)


def train(counts: DataFrame, rounds: int = ROUNDS) -> Segmenter:
    """A segmenter of word types (word, n)."""
    types = written(counts.filter("word is not null and word <> ''").select("word", F.col("n").cast("long")))
    letters, end, unknown = _letters(types)
    letters = written(letters)
    held = types.select("word", "n", F.explode(substrings(F.col("word"))).alias("part")).groupBy("part").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("types"), F.max(F.when(F.col("part") == F.col("word"), 1).otherwise(0)).alias("whole"))
    prices, _ = _priced(held.filter("types > 1 or whole = 1 or length(part) = 1").select("part", "uses"), letters, end)
    total = prices.agg(F.sum("uses")).first()[0] or 1
    worst = math.log(total) + unknown + end
    best, lengths = prices, []
    for _ in range(rounds):
        split = written(_split(types, prices, worst))
        uses = split.select("n", F.explode("parts").alias("part")).groupBy("part").agg(F.sum("n").alias("uses"))
        prices, length = _priced(uses, letters, end)
        if lengths and length >= lengths[-1] - 1e-9 * abs(lengths[-1]):
            break
        best, lengths = prices, [*lengths, length]
    return Segmenter(best, worst, lengths)


def segmented_lines(splits: DataFrame, word: str = "word") -> DataFrame:
    """word, segments joined by ' + ' and their number."""
    return splits.select(word, F.array_join("parts", " + ").alias("segments"), F.size("parts").alias("n_morph"))


# ---------------------------------------------------------------- query

def word_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of conversations, split by a segmenter that they trained."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    tokens = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.explode(words).alias("word"), F.col("conv_id").alias("doc_id"))
    return segmented_lines(train(word_counts(tokens)).split(tokens))


QUERIES, ORACLE = {"word_segments": word_segments}, {}
