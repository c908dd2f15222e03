"""What external models are asked for, and defaults that are counted on the corpus itself."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class SurprisalProvider(Protocol):
    def surprisal(self, tokens: DataFrame) -> DataFrame:
        """tokens (doc_id, pos, word) with a column surprisal."""


class FrequencyProvider(Protocol):
    def log_frequency(self, words: DataFrame) -> DataFrame:
        """words (word) with a column log_freq."""


class MorphProvider(Protocol):
    def segments(self, word: Column) -> Column:
        """The parts of a word, stem first."""


def laplace_logp(pair: Column, first: Column, vocabulary: Column) -> Column:
    """ln((pair + 1) / (first + V)); counts that are null are none."""
    return F.log((F.coalesce(pair, F.lit(0)) + 1.0) / (F.coalesce(first, F.lit(0)) + vocabulary))


class BigramSurprisal:
    """Add-one bigram surprisal within a document; its first word has none."""

    def __init__(self, corpus: DataFrame):
        order = Window.partitionBy("doc_id").orderBy("pos")
        pairs = corpus.withColumn("prev", F.lag("word").over(order)).filter("prev is not null")
        self.pairs = pairs.groupBy("prev", "word").agg(F.count(F.lit(1)).alias("c12"))
        self.words = corpus.groupBy("word").agg(F.count(F.lit(1)).alias("c1"))
        self.size = self.words.agg(F.count(F.lit(1)).cast("double").alias("vocabulary"))

    def surprisal(self, tokens: DataFrame) -> DataFrame:
        order = Window.partitionBy("doc_id").orderBy("pos")
        told = tokens.withColumn("prev", F.lag("word").over(order))
        told = told.join(self.pairs, ["prev", "word"], "left").join(self.words.withColumnRenamed("word", "prev"), "prev", "left").crossJoin(F.broadcast(self.size))  # one row
        value = F.when(F.col("prev").isNull(), 0.0).otherwise(-laplace_logp(F.col("c12"), F.col("c1"), F.col("vocabulary")))
        return told.withColumn("surprisal", value).drop("prev", "c12", "c1", "vocabulary")


class CorpusFrequency:
    def __init__(self, corpus: DataFrame):
        self.counts = corpus.groupBy("word").agg(F.count(F.lit(1)).alias("c"))
        self.total = self.counts.agg(F.sum("c").cast("double").alias("total"))

    def log_frequency(self, words: DataFrame) -> DataFrame:
        told = words.join(self.counts, "word", "left").crossJoin(F.broadcast(self.total))  # one row
        return told.withColumn("log_freq", F.log(F.coalesce("c", F.lit(0)) / F.col("total") + 1e-9)).drop("c", "total")


class SuffixSegments:
    """A word as stem and ending, by the longest of given endings that leaves a stem of some length."""

    def __init__(self, endings: list[str], stem: int = 3):
        self.endings, self.stem = sorted(endings, key=len, reverse=True), stem

    def segments(self, word: Column) -> Column:
        out = F.array(word)
        for ending in reversed(self.endings):
            fits = word.endswith(ending) & (F.length(word) >= self.stem + len(ending))
            out = F.when(fits, F.array(F.left(word, F.length(word) - len(ending)), F.lit(ending))).otherwise(out)
        return out


def first_reply(prompt: str, models: list[Callable[[str], str | None]]) -> str | None:
    """The first model's reply that isn't empty; a model that fails is passed over."""
    for model in models:
        try:
            reply = model(prompt)
        except Exception:  # noqa: BLE001  any failure of an outside service
            continue
        if reply and reply.strip():
            return reply.strip()
    return None
