"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from REACH words on both sides of it, itself masked; a document's score
is the sum of the log probabilities. The network's vocabulary is the most frequent words of all
documents; other words fall into buckets by their hash, and a word of a bucket has the bucket's
probability times the word's share of all occurrences of the bucket's words, so every counted word
has a probability of its own. As neighbours, words of a bucket are one. A hidden layer over the neighbours' embeddings (one
table for each place) predicts a word's class, and given the class the word, so that a word costs
two softmaxes of the square root of the vocabulary.

The network is trained in numpy by all tasks at once: in each round every task trains a copy on
its part of that round's share of the documents, and the copies are averaged by words, in chunks
of the parameters and in two levels. Words are counted over all documents, the rounds' shares make up all of them, and
all tasks' copies meet, so what is gathered grows with the input; the model itself doesn't.

Defined results: null text counts as empty; a text without words has score 0 over 0 words and
no mean (null). Beyond a text's ends stands an own symbol. Ties in frequency go by hash. An
empty table gives an empty result. Rows that repeat are trained on and scored each. Without any word
the network stays as it was drawn, and nothing is scored by it. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import KeyTable, grouped, word_hashes

CLASSES, MEMBERS = 64, 64
RARE = 256
FREQUENT = CLASSES * MEMBERS - RARE
EDGE = CLASSES * MEMBERS
REACH = 2
PLACES = (*range(-REACH, 0), *range(1, REACH + 1))
DIM = 16
#: A round trains on one of as many parts of the documents, so that every document is trained on once.
ROUNDS = 2
#: Words of a step, at first and at most.
LEAST_BATCH, BATCH, RATE = 512, 4096, 0.15
#: Parts that a model is averaged in, and copies that one task averages.
CHUNKS, FAN = 32, 64
COUNTED = 1_000_000
#: Rare words whose shares every task knows; the others are joined.
TOLD = 1 << 20
#: Words that are scored at once, few enough for the processor's cache.
SPAN = 4096
SHAPES = {
    # the last of DIM + 1 states is 1
    "near": (len(PLACES), EDGE + 1, DIM), "bias": (DIM,), "group": (DIM + 1, CLASSES), "member": (CLASSES, DIM + 1, MEMBERS),
}
#: Logits within this bound need no largest one taken off.
SAFE = 60.0


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: words of a task's texts and how often they occur."""
    held, size = [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        words, where = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)

    for batch in batches:
        for texts in grouped(batch.column("text").cast(pa.binary()).to_pylist()):
            held.append(np.unique(word_hashes(texts)[0], return_counts=True))
            size += len(held[-1][0])
            if size > 2 * COUNTED:
                held = [summed()]
                size = len(held[0][0])
            if size > COUNTED:
                yield _counted(*summed())
                held, size = [], 0
    if held:
        yield _counted(*summed())


def _counted(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])


class Vocabulary:
    """Ids of words: by frequency, or a bucket of rare words."""

    def __init__(self, frequent: np.ndarray):
        self.order = np.argsort(frequent)
        self.table = KeyTable(frequent[self.order])

    def ids(self, words: np.ndarray) -> np.ndarray:
        at = self.table.find(words)
        rare = FREQUENT + (words >> np.uint64(17)).astype(np.int64) % RARE
        return np.where(at >= 0, self.order[at] if len(self.order) else 0, rare)


def fresh(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    model = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    model["bias"][:] = 0
    model["group"][-1] = 0
    model["member"][:, -1] = 0
    return model


def packed(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in SHAPES])


def unpacked(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k], at = values[at: at + n].reshape(shape).copy(), at + n
    return out


def neighbours(ids: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """(place, word) ids around each word; EDGE beyond its text's ends."""
    begin = np.concatenate([[0], upto[:-1]])
    first, end = np.repeat(begin, upto - begin), np.repeat(upto, upto - begin)
    at = np.arange(len(ids))
    out = np.full((len(PLACES), len(ids)), EDGE)
    for k, place in enumerate(PLACES):
        inside = (at + place >= first) & (at + place < end)
        out[k, inside] = ids[at[inside] + place]
    return out


def hidden(model: dict, around: np.ndarray) -> np.ndarray:
    out = np.empty((around.shape[1], DIM + 1), model["bias"].dtype)
    total = model["near"][0][around[0]]
    for k in range(1, len(PLACES)):
        total += model["near"][k][around[k]]
    total += model["bias"]
    np.tanh(total, out=out[:, :DIM])
    out[:, DIM] = 1
    return out


def exponentials(x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of each row's logits in place, all over a factor if they may be large, and their sums; weights made the logits."""
    if np.abs(weights).sum(-2).max() > SAFE:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    return x, x.sum(1)


def by_class(ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by class, and (class, first, end) of each that occurs."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    group = ids[order] // MEMBERS
    cut = np.flatnonzero(np.diff(group, prepend=-1, append=CLASSES)).tolist()
    return order, [(int(group[a]), a, b) for a, b in zip(cut, cut[1:], strict=False)]


def logits(model: dict, state: np.ndarray, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of the classes, and of the members of each row's own class; rows are in order of class."""
    own = np.empty((len(state), MEMBERS), state.dtype)
    for k, a, b in spans:
        np.matmul(state[a:b], model["member"][k], out=own[a:b])
    return state @ model["group"], own


def log_probabilities(model: dict, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    order, spans = by_class(ids)
    ids = ids[order]
    rows, total = np.arange(len(ids)), np.zeros(len(ids), model["bias"].dtype)
    for x, weights, at in zip(logits(model, hidden(model, around[:, order]), spans), (model["group"], model["member"]), (ids // MEMBERS, ids % MEMBERS), strict=True):
        x, sums = exponentials(x, weights)
        # a probability may be too small for its exponential
        total += np.log(np.maximum(x[rows, at], np.finfo(x.dtype).tiny)) - np.log(sums)
    out = np.empty_like(total)
    out[order] = total
    return out


def gradients(model: dict, ids: np.ndarray, around: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log probability; 'near' is left as the gradient of the sum under the tanh.

    Rows are taken by class, so that a class is a slice and the softmax one for all.
    """
    n = len(ids)
    order, spans = by_class(ids)
    ids = ids[order]
    state = hidden(model, around[:, order])
    slopes, rows = [], np.arange(n)
    for x, weights, at in zip(logits(model, state, spans), (model["group"], model["member"]), (ids // MEMBERS, ids % MEMBERS), strict=True):
        x, sums = exponentials(x, weights)
        x /= (sums * n)[:, None]
        x[rows, at] -= 1 / n
        slopes.append(x)
    slope, own = slopes
    grad = {"group": state.T @ slope, "member": np.zeros_like(model["member"])}
    d_state = slope @ model["group"][:DIM].T
    for k, a, b in spans:
        np.matmul(state[a:b].T, own[a:b], out=grad["member"][k])
        d_state[a:b] += own[a:b] @ model["member"][k][:DIM].T
    d_state *= 1 - np.square(state[:, :DIM])
    grad["bias"] = d_state.sum(0)
    grad["near"] = np.empty_like(d_state)
    grad["near"][order] = d_state
    return grad


class Trainer:
    """Adagrad over one copy of the model; steps take more words as more have been seen."""

    def __init__(self, model: dict):
        self.model = {k: v.copy() for k, v in model.items()}
        self.squares = {k: np.full_like(v, 1e-6) for k, v in model.items()}
        self.words = 0

    def step(self, name: str, g: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        squares = self.squares[name][rows] + g * g
        self.squares[name][rows] = squares
        g *= RATE
        g /= np.sqrt(squares, out=squares)
        self.model[name][rows] -= g

    def learn(self, ids: np.ndarray, around: np.ndarray) -> None:
        flat = {"near": (len(PLACES) * (EDGE + 1), DIM)}
        a = 0
        while a < len(ids):
            size = min(BATCH, max(LEAST_BATCH, self.words // 64))
            own, near = ids[a: a + size], around[:, a: a + size]
            grad = gradients(self.model, own, near)
            slope = grad.pop("near")
            for name, g in grad.items():
                self.step(name, g)
            # all places' tables as one
            at = (near + (np.arange(len(PLACES)) * (EDGE + 1))[:, None]).ravel().astype(np.uint16)
            order = np.argsort(at, kind="stable")
            at = at[order]
            first = np.flatnonzero(np.diff(at, prepend=at[0] + 1))
            g = np.add.reduceat(slope[order % len(own)], first)
            for table in (self.model, self.squares):
                table["near"] = table["near"].reshape(flat["near"])
            self.step("near", g, at[first].astype(np.int64))
            for table in (self.model, self.squares):
                table["near"] = table["near"].reshape(SHAPES["near"])
            self.words += len(own)
            a += len(own)


def train_copies(shared, vocabulary: np.ndarray):
    """For mapInArrow: a task's trained copy in CHUNKS parts, with the words that it learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, known = Trainer(unpacked(shared.value)), Vocabulary(vocabulary)
        for batch in batches:
            for texts in grouped(batch.column("text").cast(pa.binary()).to_pylist()):
                words, upto = word_hashes(texts)
                ids = known.ids(words)
                trainer.learn(ids, neighbours(ids, upto))
        if trainer.words:
            parts = np.array_split(packed(trainer.model), CHUNKS)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([TaskContext.get().partitionId()] * CHUNKS, pa.int32()),
                pa.array([trainer.words] * CHUNKS, pa.int64()), pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary())],
                names=["chunk", "task", "words", "part"])

    return run


def average_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows in order of chunk and group: the mean of each, weighted by words, and these words."""
    at, total, weight = None, None, 0

    def mean() -> pa.RecordBatch:
        part = (total / weight).astype("<f4").tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([weight], pa.int64()), pa.array([part], pa.binary())], names=["chunk", "task", "words", "part"])

    for batch in batches:
        for chunk, group, words, part in zip(*(batch.column(c).to_pylist() for c in ("chunk", "group", "words", "part")), strict=True):
            if at != (chunk, group):
                if at is not None:
                    yield mean()
                at, total, weight = (chunk, group), 0, 0
            total = total + words * np.frombuffer(part, "<f4").astype(np.float64)
            weight += words
    if at is not None:
        yield mean()


COPIES = "chunk int, task int, words long, part binary"


def averaged(copies: DataFrame) -> DataFrame:
    """The mean of all copies by chunk: first of FAN tasks' copies each, then of these means, so that no task reads them all."""
    grouped_ = copies.withColumn("group", (F.col("task") / FAN).cast("int"))
    means = grouped_.repartition("chunk", "group").sortWithinPartitions("chunk", "group", "task").mapInArrow(average_copies, COPIES)
    every = means.withColumn("group", F.lit(0)).repartition(CHUNKS, "chunk").sortWithinPartitions("chunk", "task")
    return every.mapInArrow(average_copies, COPIES)


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of every word of all texts."""
    return docs.select("text").mapInArrow(count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counted: DataFrame) -> np.ndarray:
    rows = counted.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    return np.array([r["word"] for r in rows], np.int64).view(np.uint64)


def vocabulary_of(docs: DataFrame) -> np.ndarray:
    """Hashes of the FREQUENT most frequent words of all texts, most frequent first."""
    return most_frequent(word_counts(docs))


def rare_shares(counted: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """word, n and log_share of every word outside the vocabulary: its share of its bucket's occurrences."""
    frequent = counted.sparkSession.createDataFrame([(w,) for w in vocabulary.view(np.int64).tolist()], "word long")
    bucket = F.shiftrightunsigned("word", 17) % RARE  # as Vocabulary deals them
    rare = counted.join(F.broadcast(frequent), "word", "left_anti").withColumn("bucket", bucket)
    totals = rare.groupBy("bucket").agg(F.sum("n").alias("total"))
    return rare.join(F.broadcast(totals), "bucket").select("word", "n", F.log(F.col("n") / F.col("total")).alias("log_share"))


def told_shares(shares: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and log shares of the most frequent words of shares, at most TOLD of them."""
    counts = sorted(((r["n"], r["words"]) for r in shares.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)  # a row a frequency
    least, size = None, 0
    for n, words in counts:
        if (size := size + words) > TOLD:
            break
        least = n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    found = shares.filter(F.col("n") >= least).select("word", "log_share").toArrow()
    keys, order = np.unique(found["word"].to_numpy().astype(np.int64).view(np.uint64), return_index=True)
    return keys, found["log_share"].to_numpy()[order]


def part_of(docs: DataFrame, turn: int) -> DataFrame:
    """Texts of the documents that a round trains on; the rounds' parts make up all documents."""
    return docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == turn).select("text")


def train(docs: DataFrame, vocabulary: np.ndarray, seed: int = 3) -> np.ndarray:
    """Parameters after ROUNDS rounds, which see every document once; docs has doc_id and text (not null)."""
    spark = docs.sparkSession
    values = packed(fresh(seed))
    for turn in range(ROUNDS):
        copies = part_of(docs, turn).mapInArrow(train_copies(spark.sparkContext.broadcast(values), vocabulary), COPIES)
        means = averaged(copies).collect()  # one model
        if means:
            values = np.concatenate([np.frombuffer(r["part"], "<f4") for r in sorted(means, key=lambda r: r["chunk"])])
    return values


def network_scores(docs: DataFrame, vocabulary: np.ndarray, values: np.ndarray, told: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """doc_id, n_words and log_likelihood; a rare word counts as its bucket.

    With told, rare words there count with their own share, and an array has those that aren't there.
    """
    context = docs.sparkSession.sparkContext
    shared, told = context.broadcast(values), None if told is None else context.broadcast(told)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = unpacked(shared.value), Vocabulary(vocabulary)
        if told is not None:
            table, log_share = KeyTable(told.value[0]), np.append(told.value[1], 0.0)
        for batch in batches:
            counts, sums = [], []
            found, ends, size = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
            for texts in grouped(batch.column("text").cast(pa.binary()).to_pylist()):
                words, upto = word_hashes(texts)
                ids = known.ids(words)
                around = neighbours(ids, upto)
                each = [log_probabilities(model, ids[a: a + SPAN], around[:, a: a + SPAN]) for a in range(0, len(ids), SPAN)]
                value = np.concatenate(each).astype(np.float64) if each else np.zeros(0)
                begin = np.concatenate([[0], upto[:-1]])
                if told is not None:
                    rare = np.flatnonzero(ids >= FREQUENT)
                    at = table.find(words[rare])
                    value[rare] += log_share[at]
                    asked = np.zeros(len(ids), bool)
                    asked[rare[at < 0]] = True
                    found.append(words[asked].view(np.int64))
                    ends.append(size + np.concatenate([[0], np.cumsum(asked)])[upto])
                    size += len(found[-1])
                total = np.concatenate([[0.0], np.cumsum(value)])
                counts += (upto - begin).tolist()
                sums += (total[upto] - total[begin]).tolist()
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.float64())]
            if told is not None:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(found))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "log_likelihood", "rare"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, log_likelihood double" + ", rare array<long>" * (told is not None))


def with_mean(scored: DataFrame) -> DataFrame:
    return scored.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def score(docs: DataFrame, vocabulary: np.ndarray, values: np.ndarray) -> DataFrame:
    """The network's own scores, a rare word counting as its bucket."""
    return with_mean(network_scores(docs, vocabulary, values))


def score_words(docs: DataFrame, counted: DataFrame, vocabulary: np.ndarray, values: np.ndarray) -> DataFrame:
    """Scores with every rare word's share of its bucket; counted has the words of all docs."""
    shares = common.materialise(rare_shares(counted, vocabulary), "shares")
    scored = network_scores(docs, vocabulary, values, told_shares(shares)).withColumn("at", F.monotonically_increasing_id())
    scored = common.materialise(scored, "scored")  # numbers rows once
    parts = scored.select("at", F.explode("rare").alias("word")).join(shares, "word").groupBy("at").agg(F.sum("log_share").alias("log_share"))
    whole = F.col("log_likelihood") + F.coalesce("log_share", F.lit(0.0))
    return with_mean(scored.drop("rare").join(parts, "at", "left").select("doc_id", "n_words", whole.alias("log_likelihood")))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_likelihood and mean_log_prob of every row."""
    common.bound_batches(docs.sparkSession)
    docs = common.keyed_texts(docs)
    counted = common.materialise(word_counts(docs), "words")
    vocabulary = most_frequent(counted)
    return score_words(docs, counted, vocabulary, train(docs, vocabulary))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(common.read(spark, sf_dir, "documents"))
