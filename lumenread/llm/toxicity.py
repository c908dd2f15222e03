"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters as the embedding of its hashed form, the mean embedding of its hashed character
n-grams, and what the labels say of both: how much more often toxic documents hold the word, or
its n-grams, than chance would have it. Windows of WINDOW words that overlap by half cover every
text; a forward and a backward gated recurrent pass read each window, attention pools the states,
and one unit gives the window's logit. A document's score is the sigmoid of its largest window
logit. Scoring covers every window of every text, in parallel.

The network is trained in numpy on the driver, by Adam, from a bounded sample of labelled
documents, all windows of each. A toxic document teaches by the window that decides its score, a
clean one by that or any other; which one decides is found anew over all windows every REFRESH
steps. In training, what labels say of a document's words comes from the other FOLDS - 1 folds,
so that words that only it holds tell nothing; embeddings are dropped at random and decay.

Defined results: null text counts as empty; an empty text is one window without words and gets
a score as well. Rows that repeat are scored each. Labels that are null aren't learned from; of
several labels of a document the highest counts. Without labels of both kinds every score is the
untrained 0. A score of exactly 0.5 is predicted toxic. Scores are rounded to six digits, as sums
in single precision may differ with a text's neighbours. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, STRIDE = 64, 32
#: Bounds of the training sample, of each class: labelled documents, and characters of all of them.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 2_000_000
STEPS, REFRESH, BATCH_DOCS, RATE = 300, 100, 32, 0.012
#: Folds that label scores are taken over, share of embeddings dropped, and their decay a step.
FOLDS, DROPPED, DECAY = 5, 0.3, 2e-3
HIDDEN, DIM, WORDS, GRAMS, TOLD = 8, 12, 1 << 13, 1 << 14, 1 << 18
GRAM_SIZES = (3, 5)
PUNCTUATION = ".,;:!?\"'()[]{}|*%&$#<>-"
#: Words that a worker remembers, words that it reads at once, and words that are described at once.
TABLE, SPAN, CHUNK = 200_000, 48_000, 8192


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """24-bit hashes of the words; of the character n-grams of all words, one after the other; where each word's begin."""
    raw = [b"\x02\x02" + w.strip(PUNCTUATION).encode("utf-8", "surrogatepass") + b"\x03\x03\x03" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    left = np.repeat(size, size) - at
    power = np.uint64(0x9E3779B97F4A7C15)
    spread = (data + np.uint64(1)) * power
    spread ^= spread >> np.uint64(29)
    parts, counts = [], np.zeros(len(raw), np.int64)
    for k in GRAM_SIZES:
        total = spread[: len(at)].copy()
        for j in range(1, k):
            total = total * np.uint64(0xD6E8FEB86659FD93) + spread[j: len(at) + j]
        total ^= total >> np.uint64(32)
        total = total * power
        keep = left >= k
        parts.append((total >> np.uint64(40), np.repeat(np.arange(len(raw)), size)[keep], keep))
        counts += np.maximum(size - k + 1, 0)
    owner = np.concatenate([p[1] for p in parts])
    grams = np.concatenate([p[0][p[2]] for p in parts])[np.argsort(owner, kind="stable")].astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    # a word's own hash: the sum of its spread bytes by place, mixed
    placed = spread[: len(at)] * (2 * at.astype(np.uint64) + np.uint64(1))
    whole = np.add.reduceat(placed, first) if len(raw) else np.zeros(0, np.uint64)
    whole = (whole ^ (whole >> np.uint64(31))) * power
    return (whole >> np.uint64(40)).astype(np.int64), grams, starts


def fresh_model(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    h = HIDDEN
    return {
        "word": draw(WORDS, DIM, scale=0.05), "gram": draw(GRAMS, DIM, scale=0.05),
        "inp": draw(2 * DIM + 3, 6 * h, scale=0.3), "bias": np.zeros(6 * h, np.float32),
        "rec_f": draw(h, 3 * h, scale=0.3), "rec_b": draw(h, 3 * h, scale=0.3),
        "att": draw(2 * h, h, scale=0.3), "att_bias": np.zeros(h, np.float32), "att_out": draw(h, scale=0.3),
        "out": draw(2 * h, scale=0.3), "out_bias": np.zeros(1, np.float32),
        "told_word": np.zeros(TOLD, np.float32), "told_gram": np.zeros(TOLD, np.float32),
    }


#: Parts of a model that are counted, not trained.
COUNTED = ("told_word", "told_gram")


def label_scores(held: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """By bucket, from (label, bucket) numbers of documents that hold it: toxic ones beyond chance, in deviations."""
    expected = held.sum(0).astype(np.float32) * (sizes[1] / max(1, sizes.sum()))
    return np.clip((held[1] - expected) / np.sqrt(expected + 1) / 3, -3, 3).astype(np.float32)


class Described:
    """Words by the hashes of what they are made of."""

    def __init__(self, own: np.ndarray, grams: np.ndarray, starts: np.ndarray):
        self.own, self.grams, self.starts = own, grams, starts
        self.counts = np.diff(np.append(starts, len(grams)))

    @classmethod
    def of(cls, words: list[str]) -> Described:
        """Described some at a time, as what it takes in between is many times as large."""
        parts = [features(words[a: a + CHUNK]) for a in range(0, max(1, len(words)), CHUNK)]
        before = np.cumsum([0, *(len(grams) for _, grams, _ in parts[:-1])])
        own, grams = (np.concatenate([p[k].astype(np.int32) for p in parts]) for k in (0, 1))  # hashes have 24 bits
        return cls(own, grams, np.concatenate([starts + b for (_, _, starts), b in zip(parts, before, strict=True)]))

    def take(self, ids: np.ndarray) -> Described:
        counts = self.counts[ids]
        starts = np.cumsum(counts) - counts
        at = np.arange(int(counts.sum())) + np.repeat(self.starts[ids] - starts, counts)
        return Described(self.own[ids], self.grams[at], starts)

    def told(self, model: dict) -> np.ndarray:
        """What labels say of each word: of itself, and at most and on average of its n-grams."""
        told = model["told_gram"][self.grams % TOLD]
        mean = np.add.reduceat(told, self.starts) / self.counts.astype(told.dtype)
        return np.stack([model["told_word"][self.own % TOLD], np.maximum.reduceat(told, self.starts), mean], 1)


def inputs(model: dict, words: Described | list[str], told: np.ndarray | None = None, drop: np.random.Generator | None = None) -> tuple[np.ndarray, tuple]:
    """What each word adds to the gates, and what the way back needs."""
    if isinstance(words, list):
        words = Described.of(words)
    if told is None:
        told = words.told(model)
    own, grams, counts = words.own % WORDS, words.grams % GRAMS, words.counts.astype(np.float32)
    mean = np.add.reduceat(model["gram"][grams], words.starts, axis=0) / counts[:, None]
    learned = np.concatenate([model["word"][own], mean], 1)
    keep = None if drop is None else (drop.random((len(own), 2)) >= DROPPED).repeat(DIM, 1) / np.float32(1 - DROPPED)
    if keep is not None:
        learned = learned * keep
    joined = np.concatenate([learned, told], 1).astype(model["inp"].dtype)
    return joined @ model["inp"] + model["bias"], (own, grams, counts, joined, keep)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def recur(gates: np.ndarray, index: np.ndarray, mask: np.ndarray, rec: np.ndarray, order, states: np.ndarray, keep: list | None = None) -> None:
    """One gated recurrent pass over columns of index in the given order; states gets every step's state."""
    h = HIDDEN
    state = np.zeros((index.shape[1], h), gates.dtype)
    for t in order:
        g = gates[index[t]]
        u = state @ rec
        zr = sigmoid(g[:, : 2 * h] + u[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(g[:, 2 * h:] + r * u[:, 2 * h:])
        m = mask[t][:, None]
        if keep is not None:
            keep.append((t, state, z, r, n, u[:, 2 * h:], m))
        state = state + m * (1 - z) * (n - state)
        states[t] = state


def forward(model: dict, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows: index and mask are (time, window)."""
    h, (steps, n) = HIDDEN, index.shape
    states = np.empty((2, steps, n, h), gates.dtype)
    back = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
    recur(np.ascontiguousarray(gates[:, : 3 * h]), index, mask, model["rec_f"], range(steps), states[0], back["f"])
    recur(np.ascontiguousarray(gates[:, 3 * h:]), index, mask, model["rec_b"], range(steps - 1, -1, -1), states[1], back["b"])
    both = np.concatenate([states[0], states[1]], 2)
    hidden = np.tanh(both.reshape(-1, 2 * h) @ model["att"] + model["att_bias"]).reshape(steps, n, h)
    weight = hidden @ model["att_out"]
    weight = np.where(mask > 0, weight, -1e9)
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tn,tnk->nk", weight, both)
    if keep is not None:
        keep.update(back, both=both, hidden=hidden, weight=weight, pooled=pooled)
    return pooled @ model["out"] + model["out_bias"]


def backward(model: dict, gates: np.ndarray, index: np.ndarray, kept: dict, slope: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters behind the gates, and of the gates; slope: of each logit."""
    h, (steps, n) = HIDDEN, index.shape
    grad = {"out": kept["pooled"].T @ slope, "out_bias": slope.sum(keepdims=True)}
    d_pooled = slope[:, None] * model["out"]
    weight, both, hidden = kept["weight"], kept["both"], kept["hidden"]
    d_both = weight[:, :, None] * d_pooled
    d_weight = np.einsum("tnk,nk->tn", both, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    grad["att_out"] = np.einsum("tn,tnk->k", d_score, hidden)
    d_hidden = (d_score[:, :, None] * model["att_out"] * (1 - hidden**2)).reshape(-1, h)
    grad["att"], grad["att_bias"] = both.reshape(-1, 2 * h).T @ d_hidden, d_hidden.sum(0)
    d_both += (d_hidden @ model["att"].T).reshape(steps, n, 2 * h)
    d_gates = np.zeros_like(gates)
    for way, name, at in (("f", "rec_f", 0), ("b", "rec_b", 3 * h)):
        rec, d_rec, d_state = model[name], np.zeros_like(model[name]), np.zeros((n, h), gates.dtype)
        for t, before, z, r, new, u, m in reversed(kept[way]):
            d_state = d_state + d_both[t][:, :h] if way == "f" else d_state + d_both[t][:, h:]
            d_z = -d_state * m * (new - before) * z * (1 - z)
            d_n = d_state * m * (1 - z) * (1 - new**2)
            d_r = d_n * u * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_n * r], 1)
            d_rec += before.T @ d_u
            np.add.at(d_gates[:, at: at + 3 * h], index[t], np.concatenate([d_z, d_r, d_n], 1))
            d_state = d_state * (1 - m * (1 - z)) + d_u @ rec.T
        grad[name] = d_rec
    return grad, d_gates


def input_gradients(model: dict, kept: tuple, d_gates: np.ndarray) -> dict:
    own, grams, counts, joined, keep = kept
    d_joined = (d_gates @ model["inp"].T)[:, : 2 * DIM]
    if keep is not None:
        d_joined = d_joined * keep
    d_word, d_gram = np.zeros_like(model["word"]), np.zeros_like(model["gram"])
    np.add.at(d_word, own, d_joined[:, :DIM])
    np.add.at(d_gram, grams, np.repeat(d_joined[:, DIM:] / counts[:, None], counts.astype(np.int64), axis=0))
    return {"inp": joined.T @ d_gates, "bias": d_gates.sum(0), "word": d_word, "gram": d_gram}


def words_of(text: str) -> list[str]:
    return text.lower().split() or [""]


def window_starts(n: int) -> list[int]:
    """Starts of the windows that cover n words."""
    return list(range(0, max(1, n - STRIDE), STRIDE))


def laid_out(index: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, window) indexes and mask of the windows from starts, none past ends."""
    at = starts[None, :] + np.arange(WINDOW)[:, None]
    mask = at < ends[None, :]
    return index[np.where(mask, at, starts[None, :])], mask.astype(np.float32)


class Sample:
    """Labelled documents as words, and what labels say of words by the fold that is left out."""

    def __init__(self, samples: list[tuple[int, str]]):
        self.labels = np.array([label for label, _ in samples])
        known: dict[str, int] = {}
        self.docs = [np.array([known.setdefault(w, len(known)) for w in words_of(text)], np.int32) for _, text in samples]
        self.words = Described.of(list(known))
        self.starts = [np.array(window_starts(len(d))) for d in self.docs]
        # by label in turn, so that every fold has its share of each
        self.folds = np.empty(len(samples), np.int64)
        for k in (0, 1):
            self.folds[self.labels == k] = np.arange((self.labels == k).sum()) % FOLDS
        held = {name: np.zeros((FOLDS, 2, TOLD), np.uint16) for name in COUNTED}
        sizes = np.zeros((FOLDS, 2))
        for label, fold, doc in zip(self.labels, self.folds, self.docs, strict=True):
            own = self.words.take(np.unique(doc))
            for name, hashes in zip(COUNTED, (own.own, own.grams), strict=True):
                held[name][fold, label, np.unique(hashes % TOLD)] += 1
            sizes[fold, label] += 1
        total = {name: x.sum(0, dtype=np.int32) for name, x in held.items()}
        self.model = {name: label_scores(x, sizes.sum(0)) for name, x in total.items()}
        self.others = [{name: label_scores(total[name] - x[f], sizes.sum(0) - sizes[f]) for name, x in held.items()} for f in range(FOLDS)]
        self.told = np.empty((FOLDS, len(self.words.own), 3), np.float32)
        for f, others in enumerate(self.others):
            self.told[f] = self.words.told(others)

    def first_windows(self) -> np.ndarray:
        """The start of each document's window that holds the word of which labels say most."""
        most = self.told[:, :, 0] + self.told[:, :, 1]
        at = [int(np.argmax(most[f, d])) for f, d in zip(self.folds, self.docs, strict=True)]
        return np.array([starts[min(len(starts) - 1, k // STRIDE)] for k, starts in zip(at, self.starts, strict=True)])

    def deciding_windows(self, model: dict) -> np.ndarray:
        """The start of each document's window with the largest logit."""
        out, gates = np.zeros(len(self.docs), np.int64), np.empty((len(self.words.own), 6 * HIDDEN), np.float32)
        for fold, told in enumerate(self.told):
            for a in range(0, len(gates), CHUNK):
                ids = np.arange(a, min(len(gates), a + CHUNK))
                gates[ids] = inputs(model, self.words.take(ids), told[ids])[0]
            mine = np.flatnonzero(self.folds == fold)
            for part in np.array_split(mine, max(1, sum(len(self.docs[d]) for d in mine) // SPAN)):
                if not len(part):
                    continue
                sizes, windows = np.array([len(self.docs[d]) for d in part]), np.array([len(self.starts[d]) for d in part])
                begin = np.cumsum(sizes) - sizes
                index, starts = np.concatenate([self.docs[d] for d in part]), np.concatenate([self.starts[d] + a for d, a in zip(part, begin, strict=True)])
                ends = np.repeat(begin + sizes, windows)
                logits = np.concatenate([forward(model, gates, *laid_out(index, starts[a:a + 1024], ends[a:a + 1024])) for a in range(0, len(starts), 1024)])
                for d, a, b, first in zip(part, np.cumsum(windows) - windows, np.cumsum(windows), begin, strict=True):
                    out[d] = starts[a + int(logits[a:b].argmax())] - first
        return out


def train(samples: list[tuple[int, str]], steps: int = STEPS, seed: int = 7) -> dict | None:
    """A model from (label, text) of documents; None without both labels."""
    if not {0, 1} <= {label for label, _ in samples}:
        return None
    sample, rng, model = Sample(samples), np.random.default_rng(seed), fresh_model(seed)
    kinds = [np.flatnonzero(sample.labels == k) for k in (0, 1)]
    trained = [k for k in model if k not in COUNTED]
    moments = {k: (np.zeros_like(model[k]), np.zeros_like(model[k])) for k in trained}
    deciding, size, all_told = sample.first_windows(), len(sample.words.own), sample.told.reshape(-1, 3)
    for step in range(1, steps + 1):
        if step > 1 and step % REFRESH == 1:
            deciding = sample.deciding_windows(model)
        chosen = np.concatenate([rng.choice(kinds[0], BATCH_DOCS // 2), rng.choice(kinds[1], BATCH_DOCS - BATCH_DOCS // 2)])
        truth = sample.labels[chosen].astype(np.float32)
        begin = deciding[chosen]
        for j in np.flatnonzero((truth == 0) & (rng.random(len(chosen)) < 0.5)).tolist():
            begin[j] = rng.choice(sample.starts[chosen[j]])
        # a document's words are told of by the other folds, so words are apart by fold
        windows = [sample.folds[d] * size + sample.docs[d][a: a + WINDOW] for d, a in zip(chosen, begin, strict=True)]
        words, flat = np.unique(np.concatenate(windows), return_inverse=True)
        told = all_told[words]
        gates, kept_in = inputs(model, sample.words.take(words % size), told, rng)
        ends = np.cumsum([len(x) for x in windows])
        places, mask = laid_out(flat, ends - [len(x) for x in windows], ends)
        kept: dict = {}
        logits = forward(model, gates, places, mask, kept)
        slope = ((sigmoid(logits) - truth) / len(chosen)).astype(np.float32)
        grad, d_gates = backward(model, gates, places, kept, slope)
        grad |= input_gradients(model, kept_in, d_gates)
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k in trained:
            first, second = moments[k]
            first += 0.1 * (grad[k] - first)
            second += 0.01 * (grad[k] * grad[k] - second)
            model[k] -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        for k in ("word", "gram"):
            model[k] *= 1 - DECAY
    return model | sample.model


def parts_of(words: list[str], most: int) -> Iterator[tuple[int, list[str]]]:
    """(first word, words) of parts that overlap as windows do, so that they have the text's own windows."""
    part = most // 2 // STRIDE * STRIDE
    for a in range(0, max(1, len(words) - STRIDE), part):
        yield a, words[a: a + part + STRIDE]


class Scorer:
    """Scores whole texts; word inputs are remembered up to a bound."""

    def __init__(self, model: dict | None):
        self.model, self.known, self.gates = model, {}, None if model is None else np.empty((TABLE + SPAN, 6 * HIDDEN), np.float32)

    def logits(self, words: list[str], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        known = self.known
        if len(known) > TABLE:
            known.clear()
        size = len(known)
        index = np.array([known.setdefault(w, len(known)) for w in words])
        if len(known) > size:
            new = list(known)[size:] if size == 0 else [w for w, _ in zip(reversed(known), range(len(known) - size), strict=False)][::-1]
            self.gates[size: len(known)] = inputs(self.model, new)[0]
        out = [forward(self.model, self.gates, *laid_out(index, starts[a:a + 1024], ends[a:a + 1024])) for a in range(0, len(starts), 1024)]
        return np.concatenate(out)

    def scores(self, texts: list[str]) -> np.ndarray:
        best = np.full(len(texts), -np.inf, np.float32)
        if self.model is None:
            return np.zeros(len(texts))
        words: list[str] = []
        spans: list[tuple[int, int, int]] = []  # document, first word and the end of its windows

        def flush() -> None:
            if spans:
                starts = np.concatenate([np.array(window_starts(b - a)) + a for _, a, b in spans])
                count = [len(window_starts(b - a)) for _, a, b in spans]
                ends = np.repeat([b for _, _, b in spans], count)
                np.maximum.at(best, np.repeat([d for d, _, _ in spans], count), self.logits(words, starts, ends))
            words.clear()
            spans.clear()

        for d, text in enumerate(texts):
            for _, piece in parts_of(words_of(text), SPAN):
                if len(words) + len(piece) > SPAN:
                    flush()
                spans.append((d, len(words), len(words) + len(piece)))
                words += piece
        flush()
        return np.round(sigmoid(best.astype(np.float64)), 6)


@dataclass
class Shared:
    broadcast: object
    id: str

    @property
    def value(self):
        return self.broadcast.value


def scorer_of(shared) -> Scorer:
    return common.kept(("toxicity", shared.id), lambda: Scorer(shared.value))


def held_out():
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[int, str]]:
    """Label and text of labelled documents, whole texts: of each class the first by hash that fit the bounds."""
    spark = docs.sparkSession
    told = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keyed = common.keyed_texts(docs)
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    sizes = keyed.select("doc_id", F.length("text").alias("size")).join(told, "doc_id").groupBy("doc_id", "toxic").agg(F.sum("size").alias("size")).withColumn("order", order)
    ids = []
    for k in (0, 1):
        left = SAMPLE_CHARS
        for r in sizes.filter(F.col("toxic") == k).orderBy("order").limit(SAMPLE_DOCS).collect():
            if r["size"] <= left:
                left -= r["size"]
                ids.append((r["doc_id"], k))
    if not ids:
        return []
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int"))  # at most 2 x SAMPLE_DOCS rows
    rows = keyed.join(chosen, "doc_id").select("doc_id", "text", "toxic").collect()
    return [(r["toxic"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]


def scoring(shared, names: list[str]):
    """For mapInArrow: the named columns and each text's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared)
        for batch in batches:
            scores = pa.array(scorer.scores(batch.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), scores], names=[*names, "score"])

    return run


def shared_model(spark: SparkSession, model: dict | None) -> Shared:
    return Shared(spark.sparkContext.broadcast(model), uuid.uuid4().hex)  # of fixed size


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """Per row of docs its doc_id, held_out, score and predicted."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    scored = keyed.mapInArrow(scoring(shared_model(spark, model), ["doc_id"]), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted to be toxic, with docs' own columns."""
    spark = docs.sparkSession
    shared = shared_model(spark, train(sample(docs, labels)))
    common.bound_batches(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), common.text_or_empty().alias("text"))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_of(shared)
        for texts in parts:
            yield pd.Series(scorer.scores(texts.tolist()))

    return rows.filter(scored("text") < 0.5).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return score(docs, train(sample(docs, common.read(spark, sf_dir, "labels"))))
