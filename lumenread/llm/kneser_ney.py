"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Words (between white space, as they stand) form n-grams up to ORDER. All trusted documents are counted,
whole, but those that thresholds are taken from. Counts are kept in tables grouped by key; discounts, context
weights and probabilities come from joins of these tables. A document's perplexity is the geometric mean of
inverse probabilities over all its words.

A word's log probability is a sum over the n-grams that end with it: an n-gram that the model has brings
its gain (its log probability less what it would be if the model didn't have it), and one that precedes
a word brings its log weight as a context. So a document's log probability is a sum over its own n-grams, each
looked up once by its key: the most frequent ones of the model (HEAD) inside the tasks, all others by joins of
a share of the keys each (ROUNDS), so that the disk holds one share at a time. A key of two or more words is the xxhash64 of
its context's and tail's keys, so tables of counts needn't hold it. What a table was made from goes as soon as it is written.

A document stays if its judged perplexity is at most the threshold of its language. Judged it is
with PRIOR words of its language's mean surprise besides its own, as a few words tell little; the
threshold is the LEAVE quantile of judged perplexities times SLACK, for what the quantile leaves out
by definition. Mean and quantile are taken over trusted documents that the model wasn't trained on;
languages with fewer than FEW of them share those of all. kept is judged <= threshold, row by row.

A caller may bound what is read of a trusted text (LONGEST characters in a row, from a random place); the query doesn't.

Defined results: null text counts as empty; a text without words has no perplexity (null), is not
judged (null) and stays. Null languages form a language of their own. Without trusted text no document has a
perplexity. Rows that repeat are scored each. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import KeyTable, grouped, word_hashes

ORDER = 3
#: Characters in a row that are read of a trusted text; None: all of it.
LONGEST: int | None = None
#: n-grams of the model that every task knows, the most frequent ones; others are joined.
HEAD = 1_000_000
#: Joins that other n-grams are looked up by, one after another.
ROUNDS = 4
LEAVE, SLACK, FEW = 0.99, 1.1, 30
#: Words of usual surprise that every document is judged with, as a few words tell little.
PRIOR = 20
GRAMS = "context long, tail long, n long"
_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def long_hashes(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """xxhash64 of 8-byte numbers."""
    h = (seed + (_P5 + np.uint64(8))) ^ (turned(x * _P2, 31) * _P1)
    h = turned(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def gram_keys(words: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams that start at each word; a 1-gram's key is its word's hash, others' are those of key_of."""
    if n == 1:
        return words
    shorter = gram_keys(words, n - 1)
    return long_hashes(shorter[1:], long_hashes(shorter[:-1], np.uint64(42)))


def key_of(n: int) -> Column:
    """The key of a table's n-grams."""
    return F.col("tail") if n == 1 else F.xxhash64("context", "tail")


def count_grams(n: int):
    """For mapInArrow: counts of n-grams by the keys of their context (all but the last word) and tail (all but the first; of one word itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in grouped(batch.column("text").cast(pa.binary()).to_pylist()):
                words, upto = word_hashes(texts)
                at = np.flatnonzero(np.repeat(upto, np.diff(upto, prepend=0)) - np.arange(len(words)) >= n)  # that end in their text
                _, first, counts = np.unique(gram_keys(words, n)[at], return_index=True, return_counts=True)
                shorter, at = gram_keys(words, max(1, n - 1)), at[first]
                contexts, tails = (shorter[at], shorter[at + 1]) if n > 1 else (np.zeros(len(at), np.uint64), words[at])
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (contexts, tails, counts)], names=["context", "tail", "n"])

    return run


def written(df: DataFrame, path: str) -> DataFrame:
    """A scratch table at path; what was shuffled for it goes at once."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return common.write(df, path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@dataclass
class Model:
    """gain and log weight of n-grams by key: the most frequent ones as arrays, and all as tables of the orders unless the arrays hold them all."""

    keys: np.ndarray
    gain: np.ndarray
    weight: np.ndarray
    terms: list[DataFrame]
    log_unknown: float


def discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney from counts of counts."""
    found = {r["n"]: r["m"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}
    n1, n2, n3, n4 = (max(1, found.get(k, 0)) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def fit(trusted: DataFrame) -> Model | None:
    """The model of trusted texts (a column text without nulls)."""
    spark = trusted.sparkSession
    common.bound_batches(spark)
    paths: dict[str, str] = {}

    def table(name: str, df: DataFrame) -> DataFrame:
        paths[name] = common.scratch_path(spark, name)
        return written(df, paths[name])

    def drop(name: str) -> None:
        common.delete(spark, paths.pop(name))

    tables: list[DataFrame] = []
    for n in range(ORDER, 0, -1):
        seen = trusted.select("text").mapInArrow(count_grams(n), GRAMS)
        if n == ORDER:
            seen = seen.groupBy("context", "tail").agg(F.sum("n").alias("n"))
        else:  # lower orders count the words an n-gram was seen after
            after = tables[-1].groupBy(F.col("tail").alias("key")).agg(F.count(F.lit(1)).alias("different"))
            seen = seen.select("context", "tail").distinct().withColumn("key", key_of(n)).join(after, "key", "left").select("context", "tail", F.coalesce("different", F.lit(1)).alias("n"))
        tables.append(table(f"grams-{n}", seen))
    tables.reverse()
    lower, terms, log_unknown = None, [], 0.0
    for n, grams in enumerate(tables, 1):
        d = discounts(grams)
        less = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        sums = grams.groupBy("context").agg(F.sum("n").alias("all"), (F.sum(less) / F.sum("n")).alias("weight"), F.count(F.lit(1)).alias("types"))
        if lower is None:
            first = sums.first()  # unigrams have one context
            if first is None:
                return None
            log_unknown = float(np.log(first["weight"] / (first["types"] + 1)))
            joined = grams.withColumn("p", (F.col("n") - less) / F.lit(float(first["all"])) + F.lit(first["weight"] / (first["types"] + 1))).withColumn("gain", F.log("p") - F.lit(log_unknown))
        else:
            sums = table(f"contexts-{n}", sums.select("context", "all", "weight"))
            weights = sums.select(F.col("context").alias("key"), F.log("weight").alias("weight"))
            terms.append(table(f"terms-{n - 1}", lower.join(weights, "key", "left").select("key", "gain", F.coalesce("weight", F.lit(0.0)).alias("weight"), "n")))
            below = lower.select(F.col("key").alias("tail"), F.col("p").alias("p_below"))
            joined = grams.join(sums, "context").withColumn("own", (F.col("n") - less) / F.col("all")).join(below, "tail").withColumn("p", F.col("own") + F.col("weight") * F.col("p_below"))
            joined = joined.withColumn("gain", F.log(F.col("p") / (F.col("weight") * F.col("p_below"))))
        lower = table(f"probabilities-{n}", joined.select(key_of(n).alias("key"), *["p"] * (n < ORDER), "gain", "n"))
        drop(f"grams-{n}")
        if n > 1:
            drop(f"contexts-{n}")
            drop(f"probabilities-{n - 1}")
    terms.append(lower.select("key", "gain", F.lit(0.0).alias("weight"), "n"))
    least = head_count(terms)
    head = [t.filter(F.col("n") >= least).select("key", "gain", "weight").toArrow() for t in terms]
    keys, gain, weight = (np.concatenate([t[c].to_numpy() for t in head]) for c in ("key", "gain", "weight"))
    keys = keys.astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Model(keys[order], gain[order], weight[order], [t.filter(F.col("n") < least) for t in terms] if least > 1 else [], log_unknown)


def head_count(terms: list[DataFrame]) -> int:
    """The least count such that at most HEAD n-grams have it or a higher one; 1 if all may be known."""
    found: dict[int, int] = {}
    for term in terms:
        for r in term.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("m")).collect():
            found[r["n"]] = found.get(r["n"], 0) + r["m"]
    total, least = 0, 100_001
    for n in sorted(found, reverse=True):
        total += found[n]
        if total > HEAD:
            return least
        least = n
    return 1


class Scorer:
    """Sums of the n-grams that every task knows, and the others' keys."""

    def __init__(self, model: Model):
        self.model, self.table = model, KeyTable(model.keys)

    def parts(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]]:
        """By group of texts: words and known log probability of each text, and text, key, n and whether a word follows of the other n-grams."""
        for group in grouped(texts):
            words, upto = word_hashes(group)
            begin = np.concatenate([[0], upto[:-1]]).astype(np.int64)
            counts = upto - begin
            sums, others = counts * self.model.log_unknown, []
            owner = np.repeat(np.arange(len(group)), counts)
            left = np.repeat(upto, counts) - np.arange(len(words))  # words from each to its text's end
            for n in range(1, ORDER + 1):
                at = np.flatnonzero(left >= n)
                keys, own, followed = gram_keys(words, n)[at], owner[at], (left[at] > n) & (n < ORDER)
                place = self.table.find(keys)
                hit = place >= 0
                value = self.model.gain[place[hit]] + self.model.weight[place[hit]] * followed[hit]
                sums = sums + np.bincount(own[hit], value, len(group))
                others.append((own[~hit], keys[~hit], followed[~hit]))
            yield counts, sums, others

    def rows(self, texts: list[bytes]) -> list[tuple[int, float | None]]:
        """Words and known log probability of each text."""
        return [(int(n), float(x) if n else None) for counts, sums, _ in self.parts(texts) for n, x in zip(counts, sums, strict=True)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_words, log_prob and perplexity of every row."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    shared, name = spark.sparkContext.broadcast((model.keys, model.gain, model.weight, model.log_unknown)), uuid.uuid4().hex  # bounded by HEAD

    def scorer() -> Scorer:
        keys, gain, weight, unknown = shared.value
        return common.kept(("perplexity", name), lambda: Scorer(Model(keys, gain, weight, [], unknown)))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = scorer().rows(batch.column("text").cast(pa.binary()).to_pylist())
            counts, sums = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("lang").cast(pa.string()), batch.column("print"), pa.array(counts, pa.int64()), pa.array(sums, pa.float64())],
                names=["doc_id", "lang", "print", "n_words", "log_prob"])

    def others(share: int):
        """The other n-grams of a share of the keys."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                prints, done = batch.column("print").to_numpy(), 0
                for counts, _, found in scorer().parts(batch.column("text").cast(pa.binary()).to_pylist()):
                    for own, keys, followed in found:
                        at = np.flatnonzero(keys.view(np.int64) % ROUNDS == share)
                        yield pa.RecordBatch.from_arrays([pa.array(prints[done + own[at]]), pa.array(keys[at].view(np.int64)), pa.array(followed[at])], names=["print", "key", "followed"])
                    done += len(counts)

        return run

    texts = common.keyed_texts(docs, "lang").withColumn("print", F.xxhash64("text"))  # equal texts have equal sums
    scored = texts.mapInArrow(known, "doc_id long, lang string, print long, n_words long, log_prob double")
    if model.terms:
        terms = model.terms[0]
        for term in model.terms[1:]:
            terms = terms.unionByName(term)
        told = []
        for share in range(ROUNDS):
            asked = texts.select("print", "text").mapInArrow(others(share), "print long, key long, followed boolean")
            found = asked.join(terms.filter(F.pmod("key", F.lit(ROUNDS)) == share).select("key", "gain", "weight"), "key")
            found = found.groupBy("print").agg(F.sum(F.col("gain") + F.when(F.col("followed"), F.col("weight")).otherwise(0.0)).alias("more"))
            told.append(written(found, common.scratch_path(spark, f"told-{share}")))
        copies = texts.groupBy("print").agg(F.count(F.lit(1)).alias("copies"))
        summed = reduce(DataFrame.unionByName, told).groupBy("print").agg(F.sum("more").alias("more"))
        more = summed.join(copies, "print").select("print", (F.col("more") / F.col("copies")).alias("more"))
        scored = scored.join(more, "print", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return scored.select("doc_id", "lang", "n_words", "log_prob", F.exp(-F.col("log_prob") / F.col("n_words")).alias("perplexity"))


def held_out() -> Column:
    """Trusted documents that thresholds are taken from, not the model."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """Scores, thresholds and decisions of every row; trusted_ids: doc_id of the trusted documents."""
    trusted_ids = trusted_ids.filter(F.col("doc_id").isNotNull()).distinct()
    texts = docs.join(trusted_ids.filter(~held_out()), "doc_id", "left_semi").filter(F.col("text").isNotNull())
    if LONGEST is not None:
        begin = F.pmod(F.xxhash64("doc_id", F.lit(43)), F.greatest(F.length("text") - LONGEST, F.lit(0)) + 1)
        texts = texts.withColumn("text", F.substring("text", (begin + 1).cast("int"), F.lit(LONGEST)))
    model = fit(common.materialise(texts.select("text"), "trusted"))
    nothing = F.lit(None).cast("double")
    if model is None:
        return docs.select("doc_id", "lang", F.lit(0).cast("long").alias("n_words"), nothing.alias("log_prob"), nothing.alias("perplexity"), nothing.alias("judged"), nothing.alias("threshold"), F.lit(True).alias("kept"))
    return decide(written(score(docs, model), common.scratch_path(docs.sparkSession, "scored")), trusted_ids.filter(held_out()))


def decide(scored: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """Judged perplexity, threshold and decision of scored rows; trusted_ids: documents that means and quantiles are taken over."""
    spark = scored.sparkSession
    surprise = -F.col("log_prob")
    judged = scored.filter(F.col("perplexity").isNotNull()).join(trusted_ids, "doc_id", "left_semi")
    mean = (F.sum(surprise) / F.sum("n_words")).alias("m")
    means = [(r["lang"], r["m"]) for r in judged.groupBy("lang").agg(mean, F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FEW).collect()]
    of_all = judged.agg(mean).first()["m"]
    told = F.broadcast(spark.createDataFrame(means, "of_lang string, mean double"))  # a row a language
    own = scored.join(told, F.col("lang").eqNullSafe(F.col("of_lang")), "left").withColumn("usual", F.coalesce("mean", F.lit(of_all).cast("double")))
    own = own.withColumn("judged", F.exp((surprise + PRIOR * F.col("usual")) / (F.col("n_words") + PRIOR)))
    quantile = (F.percentile_approx("judged", LEAVE, 10_000) * SLACK).alias("q")
    trusted = own.filter(F.col("perplexity").isNotNull()).join(trusted_ids, "doc_id", "left_semi")
    limits = [(r["lang"], r["q"]) for r in trusted.filter(F.col("mean").isNotNull()).groupBy("lang").agg(quantile).collect()]
    limit = trusted.agg(quantile).first()["q"]
    limits = F.broadcast(spark.createDataFrame(limits, "limit_lang string, limit double"))
    out = own.join(limits, F.col("lang").eqNullSafe(F.col("limit_lang")), "left").withColumn("threshold", F.coalesce("limit", F.lit(float("inf") if limit is None else limit)))
    return out.select("doc_id", "lang", "n_words", "log_prob", "perplexity", "judged", "threshold", F.coalesce(F.col("judged") <= F.col("threshold"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    return classify(docs, labels.filter(F.col("quality") == 1).select("doc_id"))
