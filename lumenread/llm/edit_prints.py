"""Document fingerprints by a randomised embedding of edit distance into Hamming distance.

Every text is walked by the same random rule: at step j the walk notes the character it stands
on and stays or moves on by a random bit that depends on j and the character only. Texts that
differ by few edits fall into step again after each, so their notes differ in few steps.
A fingerprint samples the notes: step j has a random priority, a text of level l keeps the
steps of priority l and above, and l is such that about LEAST to 2 x LEAST steps are kept.
Fingerprints of different levels are compared on the steps that the coarser one has.

Bands are made from sampled steps; texts that agree in a band are candidates, and the likeness
of the whole fingerprints verifies them.

Defined results: null text counts as empty; the fingerprint of an empty text holds no notes and
is like another empty one only. The next document is the next row by doc_id, then text; null
doc_ids come first; after the last row comes the first, and a single row is next to itself.
Rows that repeat are rows of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST, MOST = 192, 1024
SEED, BLOCK = 23, 1024
#: Texts that walk side by side, and how many bytes of them.
GROUP, GROUP_BYTES = 4096, 24 << 20
#: Notes of a band at least, the likeness that bands are made for, and the share of pairs just as like that no band may find.
BAND_NOTES, LIKE, MISSED = 6, 0.75, 0.1
#: Share of notes that texts without a relation have in common (measured), rungs of theirs that can meet, and how many others a text may meet by chance.
BY_CHANCE, RUNGS, MET = 0.13, 6, 1.0
#: Fewer texts than these walk one by one; partitions at most, and rows sampled for each one's bounds: what the driver sorts.
FEW, MOST_PARTS, SAMPLED = 6, 2048, 200
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def priorities(first: int, n: int) -> np.ndarray:
    """Random priorities of n steps: 0 for half of them, 1 for a quarter and so on."""
    x = np.arange(first, first + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    low = x & (~x + np.uint64(1))
    return np.where(x == 0, 63, np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64)


@lru_cache(64)
def move_bits(block: int) -> np.ndarray:
    """The random bit of each step of a block and character class; class 0, the end, never moves."""
    bits = np.unpackbits(np.random.default_rng((SEED, block)).integers(0, 256, (BLOCK, 32), dtype=np.uint8), axis=1)
    bits[:, 0] = 0
    return bits


def moves(block: int) -> np.ndarray:
    return move_bits(block).astype(np.int64)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return ((points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def level_of(n_chars: int) -> int:
    """A walk takes about two steps a character."""
    return max(0, (2 * n_chars // LEAST).bit_length() - 1)


def walk_on(data: np.ndarray, at: int, block: int, level: int, notes: np.ndarray, kept: int) -> None:
    """One text's walk from a place on, at the beginning of a block, to its end; kept notes are there already."""
    raw = data.tobytes() if len(data) < 1 << 20 else memoryview(data)
    while raw[at]:
        bits, marks = move_bits(block), np.flatnonzero(priorities(block * BLOCK, BLOCK) >= level).tolist()
        rows = [r.tobytes() for r in bits]
        j = 0
        for mark in (*marks, BLOCK):
            for row in rows[j:mark]:
                at += row[raw[at]]
            if mark < BLOCK:
                if kept < len(notes):
                    notes[kept] = raw[at]
                kept += 1
                at += rows[mark][raw[at]]
            j = mark + 1
        block += 1


def fingerprints(texts: list[str]) -> list[str]:
    """Level as two hex digits, then a hex digit a note."""
    if not texts:
        return []
    coded = [classes(t) for t in texts]
    sizes = np.array([len(c) for c in coded])
    order = np.argsort(-sizes, kind="stable")
    levels = np.array([level_of(n) for n in sizes[order].tolist()])
    stop = np.zeros(1, np.uint8)
    data = np.concatenate([x for i in order.tolist() for x in (coded[i], stop)])
    begin = np.cumsum(sizes[order] + 1) - sizes[order] - 1
    notes = np.zeros((len(texts), MOST), np.uint8)
    kept = np.zeros(64, np.int64)  # steps so far, by level
    lane, at = np.arange(len(texts)), begin.copy()
    spans: list[tuple[int, int, int]] = []

    def split() -> list[tuple[int, int, int]]:
        own = levels[lane]
        cut = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
        return [(int(own[a]), int(a), int(b)) for a, b in zip(cut, cut[1:], strict=False)][::-1]

    spans = split()
    block = 0
    while len(lane):
        if len(lane) < FEW:  # single long texts: step by step is faster than side by side
            for k, place in zip(lane.tolist(), at.tolist(), strict=True):
                walk_on(data, place, block, int(levels[k]), notes[k], int(kept[levels[k]]))
            break
        go, rank = move_bits(block), priorities(block * BLOCK, BLOCK).tolist()
        for j in range(BLOCK):
            here = data[at]
            top = rank[j]
            for level, a, b in spans:
                if level > top:
                    break
                if kept[level] < MOST:
                    notes[lane[a:b], kept[level]] = here[a:b]
            kept[: top + 1] += 1
            at += go[j][here]
            if j % 128 == 127:
                live = data[at] != 0
                if (n := int(live.sum())) < 0.95 * len(lane):
                    lane, at = lane[live], at[live]
                    if not n:
                        break
                    spans = split()
        block += 1
        if not (data[at] != 0).any():
            break
    out = [""] * len(texts)
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    filled = (notes != 0).sum(1)
    shown = digits[notes % 16]
    for k, i in enumerate(order.tolist()):
        out[i] = f"{int(levels[k]):02x}" + shown[k, : filled[k]].tobytes().decode()
    return out


class Steps:
    """Priorities of the steps that each level keeps, in order."""

    def __init__(self):
        self.known: dict[int, np.ndarray] = {}

    def of(self, level: int) -> np.ndarray:
        if level not in self.known:
            found, first, size = [], 0, 1 << 16
            while sum(map(len, found)) < MOST:
                rank = priorities(first, size)
                found.append(rank[rank >= level])
                first, size = first + size, 2 * size
            self.known[level] = np.concatenate(found)[:MOST]
        return self.known[level]


STEPS = Steps()


def notes_at(print_: str, level: int) -> np.ndarray:
    """The notes of a fingerprint on the steps that a level keeps."""
    own = int(print_[:2], 16)
    notes = np.frombuffer(print_[2:].encode(), np.uint8)
    return notes if own >= level else notes[STEPS.of(own)[: len(notes)] >= level]


def likeness(a: str, b: str) -> float:
    """Share of equal notes on the steps that both keep; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    level = max(int(a[:2], 16), int(b[:2], 16))
    x, y = notes_at(a, level), notes_at(b, level)
    both = min(len(x), len(y))
    return float((x[:both] == y[:both]).sum()) / max(len(x), len(y), 1)


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by the first as many characters of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def walk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows by doc_id, the first row of the next partition at the end."""
    held: list[tuple] = []  # doc_id, text; the last one waits for its next
    size, ahead = 0, None

    def told(following: str) -> pa.RecordBatch:
        ids, texts = zip(*held, strict=True)
        nexts = [*texts[1:], following]
        changed = [edited(t, x) for t, x in zip(texts, nexts, strict=True)]
        prints = fingerprints([*texts, following, *changed])
        own, other = prints[: len(texts)], prints[len(texts) + 1:]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()), pa.array(own, pa.string()), pa.array(other, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, other, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, prints[1: len(texts) + 1], strict=True)], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        for ids, text, look in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "look")), strict=True):
            if look:
                ahead = text if ahead is None else ahead
                continue
            if len(held) >= GROUP or size > GROUP_BYTES:
                yield told(text)
                held, size = [], 0
            held.append((ids, text))
            size += len(text)
    if held:
        yield told(ahead if ahead is not None else held[0][1])


def buckets_of(cuts: list[tuple[int, int]]):
    """A column function: how many cuts (at, head) are at most a row's."""
    cut_at, cut_head = (np.array(c, np.int64) for c in (zip(*cuts, strict=True) if cuts else ((), ())))

    @F.pandas_udf("int")
    def bucket(at: pd.Series, head: pd.Series) -> pd.Series:
        own, heads = at.to_numpy(np.int64), head.to_numpy(np.int64)
        low, high = np.searchsorted(cut_at, own, side="left"), np.searchsorted(cut_at, own, side="right")
        out = low.copy()
        for k in np.unique(low[low < high]).tolist():  # rows with an id that is itself a bound
            rows = np.flatnonzero((low == k) & (low < high))
            out[rows] += np.searchsorted(cut_head[k: high[rows[0]]], heads[rows], side="right")
        return pd.Series(out.astype(np.int32))

    return bucket


def in_order(docs: DataFrame) -> DataFrame:
    """docs by doc_id over partitions, each followed by the row (look) that comes after its last one.

    Bounds are quantiles of a sample, by id and then by the first bytes of the text, so rows without an
    id, or with one id, are dealt to as many partitions as they need.
    """
    spark = docs.sparkSession
    first = F.rpad(F.hex(F.substring(F.encode("text", "UTF-8"), 1, 7)), 14, "0")
    keyed = common.keyed_texts(docs).withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long"))
    keyed = keyed.withColumn("head", F.coalesce(F.conv(first, 16, 10).cast("long"), F.lit(0).cast("long")))
    parts = min(MOST_PARTS, common.sized_partitions(spark, docs))  # a task streams its rows, however many
    share = min(1.0, parts * SAMPLED / max(1, docs.count()))
    some = sorted((r["at"], r["head"]) for r in keyed.select("at", "head").sample(share, seed=SEED).collect())  # about parts x SAMPLED rows
    cuts = sorted({some[k * len(some) // parts] for k in range(1, parts)}) if some else []
    bucket = buckets_of(cuts)
    dealt = keyed.withColumn("bucket", bucket("at", "head"))
    # the first row of each partition is also looked at by the one before it
    heads = common.materialise(dealt.groupBy("bucket").agg(F.min(F.struct("at", "text", "doc_id")).alias("r")).select("bucket", "r.*"), "heads")
    present = sorted(r["bucket"] for r in heads.select("bucket").collect())  # a row a partition
    before = F.broadcast(spark.createDataFrame([(b, present[k - 1]) for k, b in enumerate(present)], "bucket int, target int"))
    looked = heads.join(before, "bucket").select("doc_id", "text", "at", F.col("target").alias("bucket"), F.lit(True).alias("look"))
    every = dealt.select("doc_id", "text", "at", "bucket", F.lit(False).alias("look")).unionByName(looked)
    return every.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("look", "at", "text").select("doc_id", "text", "look")


def prints_of(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.documents_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fingerprints(texts), pa.string())], names=["doc_id", "fingerprint"])

    return common.keyed_texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def extents(n: int) -> list[int]:
    """Lengths of a fixed ladder that a fingerprint of n notes draws bands over.

    Texts with a likeness of 0.75 differ by a quarter in notes at most, and share a rung that covers
    nearly all of the shorter one.
    """
    rungs = dict.fromkeys(int(BAND_NOTES * 1.15**k) for k in range(40))
    return [e for e in rungs if 0.65 * n - 1 <= e <= n]


def bands_for(texts: int) -> tuple[int, int]:
    """Notes of a band and bands for a number of different texts.

    A band is as long as it takes for a text to meet few others by chance, and as few whatever their number; there
    are as many bands as it takes for texts of likeness LIKE to share one but for MISSED of them.
    """
    notes = BAND_NOTES
    while True:
        bands = math.ceil(-math.log(MISSED) / LIKE**notes)
        if texts * RUNGS * bands * BY_CHANCE**notes <= MET:
            return notes, bands
        notes += 1


@lru_cache(None)
def band_places(extent: int, band: int, notes: int) -> np.ndarray:
    return np.sort(np.random.default_rng((SEED, extent, band)).choice(extent, min(notes, extent), replace=False))


def band_keys(print_: str, notes: int, bands: int) -> list[str]:
    """Keys of bands of notes from all over the fingerprint, at its level and at the next coarser one."""
    own = int(print_[:2], 16)
    out = []
    for level in (own, own + 1):
        noted = notes_at(print_, level)
        out += [f"{level}.{e}.{band}." + noted[band_places(e, band, notes)].tobytes().decode() for e in extents(len(noted)) for band in range(bands)]
    return out or [print_]


def banded(notes: int, bands: int):
    """For mapInArrow over different fingerprints (node, fingerprint): node and the hash of each of its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, print_ in zip(batch.column("node").to_pylist(), batch.column("fingerprint").to_pylist(), strict=True):
                own = {xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in band_keys(print_, notes, bands)}
                yield pa.RecordBatch.from_arrays([pa.array([node] * len(own), pa.int64()), pa.array([*own], pa.int64())], names=["node", "key"])

    return run


def candidates(firsts: DataFrame) -> DataFrame:
    """(node, other): every two different fingerprints (node, fingerprint) that share a band."""
    notes, bands = bands_for(firsts.count())
    keys = firsts.select("node", "fingerprint").mapInArrow(banded(notes, bands), "node long, key long")
    # most keys are one text's and go at once; only those that texts share are kept
    keys = common.materialise(keys.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1").select("node", "key"), "bands")
    return keys.join(keys.select("key", F.col("node").alias("other")), "key").filter("node < other").select("node", "other").distinct()


def near_copies(prints: DataFrame, least: float = 0.75) -> DataFrame:
    """(doc_id, lead_id, near): every two candidates whose likeness is at least so high, lead_id the smaller.

    Equal fingerprints are one candidate, that of the smallest doc_id, and their other rows are pairs with
    it. Of all different fingerprints that share a band every two are compared, none left out, so pairs
    grow with the square of the number of different near copies in a group. Null doc_ids are in no pair.
    """
    firsts = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null")
    firsts = common.materialise(firsts.withColumn("node", F.xxhash64("fingerprint", "doc_id")), "prints")
    copies = prints.join(firsts.select("fingerprint", F.col("doc_id").alias("lead_id")), "fingerprint").filter("doc_id > lead_id")
    copies = copies.select("doc_id", "lead_id", F.lit(1.0).alias("near")).distinct()
    pairs = candidates(firsts)
    one = firsts.select("node", F.col("doc_id").alias("a"), F.col("fingerprint").alias("print_a"))
    two = firsts.select(F.col("node").alias("other"), F.col("doc_id").alias("b"), F.col("fingerprint").alias("print_b"))

    @F.pandas_udf("double")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    verified = pairs.join(one, "node").join(two, "other").withColumn("near", near("print_a", "print_b")).filter(F.col("near") >= least)
    ordered = verified.select(F.greatest("a", "b").alias("doc_id"), F.least("a", "b").alias("lead_id"), "near")
    return ordered.unionByName(copies)


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents by bands of their fingerprints, each pair verified."""
    return near_copies(common.materialise(prints_of(common.read(spark, sf_dir, "documents")), "prints"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bound_batches(spark)
    return in_order(common.read(spark, sf_dir, "documents")).mapInArrow(walk_rows, SCHEMA)
