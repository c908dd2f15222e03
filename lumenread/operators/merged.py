"""A corpus merged from readers: means over what is kept of words and sentences, and what each reader did.

words has a row for each reader, sentence and word of the text (skipped ones with n_fix 0): reader, sid, wnum,
the four measures, n_fix, good (the reader's sentence is usable) and keep (no outlier). sentences has a
row for each reader and sentence: reader, sid, time, good and correct (null: not asked).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenread.operators import gaze
from lumenread.plans.gaze import OUTLIERS, outlier_tests
from lumenread.sources import tables


def _kept() -> Column:
    return (F.col("keep") == 1) & (F.col("n_fix") > 0)


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _tenths(x: Column) -> Column:
    """One decimal, the same whatever order a sum was made in: what the order changes is rounded away first."""
    return F.round(F.round(x, 6), 1)


def _means() -> list[Column]:
    return [_tenths(F.avg(F.when(_kept(), F.col(m)))).alias(m) for m in gaze.MEASURES]


def word_means(words: DataFrame) -> DataFrame:
    """Each word's readers with a good sentence, those kept, the share that skipped it, and the kept readers' means."""
    good = F.col("good")
    skipped = 1 - _count(good & (F.col("n_fix") > 0)) / F.when(_count(good) > 0, _count(good))
    return words.groupBy("sid", "wnum").agg(_count(good).alias("n_good"), _count(_kept()).alias("n_kept"), F.round(skipped, 3).alias("skip_rate"), *_means())


def sentence_means(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """Each sentence's readers, the good ones and their mean time, the kept words' means, and the share of right answers."""
    read = sentences.groupBy("sid").agg(F.count(F.lit(1)).alias("n_readers"), _count(F.col("good")).alias("n_good"), _tenths(F.avg(F.when(F.col("good"), F.col("time")))).alias("time"), F.round(F.avg("correct"), 3).alias("accuracy"))
    return read.join(words.groupBy("sid").agg(*_means()), "sid", "left")


def participants(sentences: DataFrame) -> DataFrame:
    """Each reader's sentences, the good ones among them, and the share of right answers."""
    return sentences.groupBy("reader").agg(F.count(F.lit(1)).alias("sentences"), _count(F.col("good")).alias("good"), F.round(F.avg("correct"), 3).alias("accuracy"))


# ---------------------------------------------------------------- queries: sentences of 20 events and six words

def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """words and sentences of the fixation log; a sentence is answered if it is complete, and right if no event of it is an error."""
    fix, good = gaze.sentence_parts(spark, sf_dir)
    sentences = fix.groupBy(F.col("user_id").alias("reader"), "sid").agg(F.sum("d").alias("time"), F.when(F.count(F.lit(1)) == 20, F.min(F.when(F.col("event_type") == "error", 0).otherwise(1))).alias("correct"))
    good = good.withColumnRenamed("user_id", "reader")
    sentences = sentences.join(good, ["reader", "sid"])
    measured = gaze.reading_measures(fix.filter("noise = ''"), ("user_id", "sid")).withColumnRenamed("user_id", "reader")
    grid = good.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("wnum"))
    words = grid.join(measured, ["reader", "sid", "wnum"], "left").fillna(0, ["n_fix", *gaze.MEASURES])
    return gaze.with_outliers(words, "reader", "good"), sentences


def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_means(corpus(spark, sf_dir)[0])


def corpus_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, sentences = corpus(spark, sf_dir)
    return sentence_means(sentences, words)


def corpus_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return participants(corpus(spark, sf_dir)[1])


def _oracle() -> dict[str, str]:
    """Written apart: the words' rules as for outliers, then plain sums."""
    ctes = OUTLIERS.replace("{fix}", f"({tables.FIX_SQL})")
    high = " or ".join(outlier_tests())
    means = ", ".join(f"round(round(avg(case when kept then {m} end), 6), 1) as {m}" for m in gaze.MEASURES)
    words = f"""{ctes}, k as (select p.*, p.ok and not ({high}) as kept from p left join l on l.user_id = p.user_id), grid as (select q.*, unnest(range(6)) as w from q),
    a as (select g.user_id, g.sid, g.w, g.ok, coalesce(k.kept, false) as kept, k.w is not null as fixated, {", ".join(f"k.{m}" for m in gaze.MEASURES)} from grid g left join k on k.user_id = g.user_id and k.sid = g.sid and k.w = g.w)"""
    read = f"{ctes}, s_ as (select e.user_id, e.sid, sum(e.d) as t, case when count(*) = 20 then 1 - max((e.event_type = 'error')::int) end as correct, any_value(q.ok) as ok from e join q on q.user_id = e.user_id and q.sid = e.sid group by e.user_id, e.sid)"
    both = words + ", " + read[len(ctes) + 2:]
    return {
        "corpus_words": f"{words} select sid, cast(w as int) as wnum, count(case when ok then 1 end) as n_good, count(case when kept then 1 end) as n_kept, round(1 - count(case when ok and fixated then 1 end) / nullif(count(case when ok then 1 end), 0), 3) as skip_rate, {means} from a group by sid, w",
        "corpus_sentences": f"{both}, r as (select sid, count(*) as n_readers, count(case when ok then 1 end) as n_good, round(round(avg(case when ok then t end), 6), 1) as time, round(avg(correct), 3) as accuracy from s_ group by sid) select r.*, {means} from r join a on a.sid = r.sid group by all",
        "corpus_participants": f"{read} select user_id as reader, count(*) as sentences, count(case when ok then 1 end) as good, round(avg(correct), 3) as accuracy from s_ group by user_id"}


QUERIES = {"corpus_words": corpus_words, "corpus_sentences": corpus_sentences, "corpus_participants": corpus_participants}
ORACLE = _oracle()
