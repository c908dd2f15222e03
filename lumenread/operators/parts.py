"""How often words and pairs of neighbours occur in all texts, told to the texts by parts of them.

A part is some PART tokens that a task reads one after another. A task asks once for each different word and pair of a part,
by key, and says how often the part has it; who is asked for a share of the keys sums up and answers in the order of the question. So what
is dealt out is a compressed key for each different word and pair of a part and a count back, not a row a token; a part's tokens
are kept as numbers of its own words in a table meanwhile. A part holds what it is asked to hold whatever the length of texts: long
ones are cut into pieces of PIECE words, which know the words beside them.

A word's key is its xxhash64, a pair's are 64 bits of both words' keys and the bucket that it is asked for in, which comes from others.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenread.operators.depths import written
from lumenread.sources.tables import LETTERS

#: Tokens of a part, and words of a piece of a text.
PART, PIECE = 1_000_000, 4096
#: Pieces and parts that a task reads at once, and rows that it hands over at once.
READ, PARTS, ROWS = 200, 4, 200_000
#: Shares of the buckets that are asked one after another, so that the disk holds one share's questions at a time.
ROUNDS = 2
#: Bytes of input for each bucket of keys.
BUCKET_BYTES = 2 << 20
DECIMALS = 6
_C1, _C2, _C3, _C4, _C5 = map(np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that all bits of x have a part in."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(mixed(a + _C1) ^ (b * _C4))


def word_buckets(a: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(a ^ _C5) % np.uint64(buckets)).astype(np.int64)


def pair_buckets(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(mixed(b + _C5) ^ (a * _C1)) % np.uint64(buckets)).astype(np.int64)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, compressed: first bytes of all numbers, second bytes and so on."""
    raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in arrays)
    head = struct.pack(f"<{len(arrays) * 2 + 2}q", len(arrays), len(raw), *(v for x in arrays for v in (len(x), x.itemsize)))
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    """The arrays, as unsigned numbers."""
    count, size = struct.unpack_from("<2q", blob)
    shapes = struct.unpack_from(f"<{2 * count}q", blob, 16)
    raw, at, found = np.frombuffer(pa.decompress(blob[16 + 16 * count:], size, codec="zstd"), np.uint8), 0, []
    for n, width in zip(shapes[::2], shapes[1::2], strict=True):
        found.append(np.ascontiguousarray(raw[at: at + n * width].reshape(width, n).T).view(f"u{width}").reshape(n))
        at += n * width
    return found


def steps(x: np.ndarray) -> np.ndarray:
    """From each number of an ascending array to the next, from 0 on; cumsum is the way back."""
    return np.diff(x, prepend=x.dtype.type(0))


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of x in order, and which of them each value is; as np.unique, in less memory."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    which = np.empty(len(x), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], which


class Part:
    """Numbers of a part's words and pairs, in the order in which they are asked for.

    words are the keys of its different words, ids the number of each token's word, sizes the pieces' lengths. pairs has a number for
    each token that has a next one in its piece (inside).
    """

    def __init__(self, words: np.ndarray, ids: np.ndarray, sizes: np.ndarray, buckets: int):
        self.words, self.ids, self.sizes = words, ids, sizes
        ends = np.cumsum(sizes)
        self.firsts, self.lasts = ends - sizes, ends - 1
        self.inside = np.ones(len(ids), bool)
        self.inside[self.lasts] = False
        codes = ids.astype(np.int64)
        codes *= len(words)
        codes[:-1] += ids[1:]
        codes, which = numbered(codes[self.inside])
        a, b = words[codes // len(words)], words[codes % len(words)]
        del codes
        keys, self.buckets = pair_keys(a, b), pair_buckets(a, b, buckets)
        order = np.lexsort((keys, self.buckets))
        self.keys, self.buckets = keys[order], self.buckets[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.pairs = place[which]


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of words' keys, by bucket and key, and which of them each is."""
    words, ids = numbered(hashes)
    order = np.argsort(word_buckets(words, buckets), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return words[order], place[ids]


def owned(sizes: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which tokens of pieces are theirs, not a neighbour's."""
    ends = np.cumsum(sizes)
    mine = np.ones(int(sizes.sum()), bool)
    mine[(ends - sizes)[before]] = False
    mine[(ends - 1)[after]] = False
    return mine


def keep(buckets: int, part_tokens: int):
    """For mapInArrow: the parts of pieces (doc_id, start, before, after, words), each in a row: its words and tokens in numbers, and the pieces' documents."""

    def kept(table: pa.Table, number: int) -> pa.RecordBatch:
        words = table.column("words").combine_chunks()
        sizes = words.value_lengths().to_numpy().astype(np.uint32)
        before, after = (table.column(c).to_numpy().astype(np.uint8) for c in ("before", "after"))
        different, ids = by_bucket(words.flatten().to_numpy().view(np.uint64), buckets)
        blob = packed(different, ids.view(np.uint32), sizes, table.column("start").to_numpy().astype(np.uint32), before, after)
        docs = table.column("doc_id").combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([blob], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)], names=["part", "blob", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 20
        for batch in batches:
            held.append(batch)
            size += len(batch.column("words").flatten())
            if size >= part_tokens:
                yield kept(pa.Table.from_batches(held), number)
                held, size, number = [], 0, number + 1
                pa.default_memory_pool().release_unused()
        if size:
            yield kept(pa.Table.from_batches(held), number)

    return run


def ask(buckets: int, asked: range):
    """For mapInArrow, of parts: what each asks of some of the buckets, its different words' and pairs' keys and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                words, ids, sizes, _, before, after = unpacked(blob.as_py())
                part = Part(words, ids.view(np.int32), sizes.astype(np.int64), buckets)
                mine = owned(part.sizes, before.astype(bool), after.astype(bool))
                word_n = np.bincount(part.ids[mine], minlength=len(words)).astype(np.uint32)
                pair_n = np.bincount(part.pairs[mine[part.inside]], minlength=len(part.keys)).astype(np.uint32)
                w, p = (np.searchsorted(x, [*asked, asked.stop]) for x in (word_buckets(words, buckets), part.buckets))
                blobs = [packed(steps(words[a:b]), word_n[a:b], steps(part.keys[c:d]), pair_n[c:d]) for a, b, c, d in zip(w, w[1:], p, p[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(asked), pa.int64()), pa.array(asked, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "to", "blob"])
                pa.default_memory_pool().release_unused()

    return run


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow, of questions by bucket: for each part the sums of what it asked for, in its order; words says how many different ones a bucket has."""

    def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
        found, which = numbered(np.concatenate(keys))
        sums = np.bincount(which, np.concatenate(counts), len(found)).astype(np.uint64)[which]
        return np.split(sums, np.cumsum([len(x) for x in keys])[:-1]), len(found)

    def answered(bucket: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        arrays = [unpacked(blob) for _, blob in rows]
        words, different = summed([np.cumsum(x[0], dtype=np.uint64) for x in arrays], [x[1] for x in arrays])
        pairs, _ = summed([np.cumsum(x[2], dtype=np.uint64) for x in arrays], [x[3] for x in arrays])
        blobs = [packed(w, p) for w, p in zip(words, pairs, strict=True)]
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([part for part, _ in rows], pa.int64()), pa.array([bucket] * n, pa.int64()), pa.array(blobs, pa.binary()), pa.array([different] + [0] * (n - 1), pa.int64())], names=["part", "to", "blob", "words"])

    at, held = None, []
    for batch in batches:
        for part, to, blob in zip(batch.column("part").to_pylist(), batch.column("to").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if to != at and held:
                yield answered(at, held)
                held = []
            at = to
            held.append((part, blob))
    if held:
        yield answered(at, held)


def rounded(x: np.ndarray) -> np.ndarray:
    """To DECIMALS as SQL's round does it, half away from zero by the shortest decimal form."""
    scaled = x * 10.0**DECIMALS
    found = np.rint(scaled)
    for k in np.flatnonzero(np.abs(np.abs(scaled - found) - 0.5) < 1e-4):
        found[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-DECIMALS), ROUND_HALF_UP).scaleb(DECIMALS))
    return found / 10.0**DECIMALS + 0.0


def tell(buckets: int, vocabulary: int):
    """For mapInArrow, of parts' tokens and answers: doc_id, pos, and what each token costs given the one before and the one after."""

    def told(docs: pa.Array, tokens: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        words, ids, sizes, starts, before, after = unpacked(tokens)
        part = Part(words, ids.view(np.int32), sizes.astype(np.int64), buckets)
        word_n, pair_n = (np.concatenate(x).astype(np.float64) for x in zip(*map(unpacked, answers), strict=True))
        word_n += vocabulary
        pair_n += 1.0
        upto = np.cumsum(part.inside, dtype=np.int32)  # pairs up to each token's, where it has one
        mine = owned(part.sizes, before.astype(bool), after.astype(bool))
        for lo in range(0, len(mine), ROWS):
            at = np.flatnonzero(mine[lo: lo + ROWS]) + lo
            piece = np.searchsorted(part.lasts, at)
            fwd, bwd = np.full((2, len(at)), np.log(1.0 / vocabulary))
            with_last, with_next = at != part.firsts[piece], part.inside[at]
            k = at[with_last] - 1
            fwd[with_last] = np.log(pair_n[part.pairs[upto[k] - 1]] / word_n[part.ids[k]])
            k = at[with_next]
            bwd[with_next] = np.log(pair_n[part.pairs[upto[k] - 1]] / word_n[part.ids[k + 1]])
            pos = at - part.firsts[piece] - before[piece] + starts[piece] + 1
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(piece)), pa.array(pos.astype(np.int64)), pa.array(rounded(fwd)), pa.array(rounded(bwd))], names=["doc_id", "pos", "fwd", "bwd"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, docs, tokens, answers = None, None, b"", []
        for batch in batches:
            for k, (part, to) in enumerate(zip(batch.column("part").to_pylist(), batch.column("to").to_pylist(), strict=True)):
                if to < 0:
                    if at is not None:
                        yield from told(docs, tokens, answers)
                        pa.default_memory_pool().release_unused()
                    at, docs, tokens, answers = part, pa.concat_arrays([batch.column("docs")[k].values]), batch.column("blob")[k].as_py(), []
                else:
                    assert part == at, "a part without its tokens"
                    answers.append(batch.column("blob")[k].as_py())
        if at is not None:
            yield from told(docs, tokens, answers)

    return run


def pieces(texts: DataFrame, piece: int) -> DataFrame:
    """doc_id, start, before, after and words (their keys) of each row's text: piece words from start on, and the ones before and after if there are any."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))
    rows = texts.select("doc_id", F.explode(F.array(words)).alias("words")).filter(F.size("words") > 0)
    each = rows.select("doc_id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(piece))).alias("start"))
    before, after = F.col("start") > 0, F.col("start") + piece < F.size("words")
    each = each.select("doc_id", "words", "start", before.alias("before"), after.alias("after"))
    first, length = F.col("start") + 1 - F.col("before").cast("int"), F.lit(piece) + F.col("before").cast("int") + F.col("after").cast("int")
    return each.select("doc_id", "start", "before", "after", F.transform(F.slice("words", first, length), lambda x: F.xxhash64(x)).alias("words"))


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the files that df's plan scans; relations of unknown size count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 50)


def written_alone(df: DataFrame, rows: int) -> DataFrame:
    """df from a table; what was shuffled for it goes at once, and batches for Python have so many rows at most while it is made."""
    spark = df.sparkSession
    held = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}
    usual = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        return written(df)
    finally:
        for k, v in usual.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def costs(texts: DataFrame, part: int = PART, piece: int = PIECE) -> DataFrame:
    """doc_id, pos, fwd and bwd of every token of texts (doc_id, text): log of (n + 1) / (m + V), where n is how often it and the one before (after)
    come together, m how often the one before (after) occurs and V the number of words; log of 1 / V at a text's ends."""
    spark, kind = texts.sparkSession, dict(texts.dtypes)["doc_id"]
    size, usual = scanned_bytes(texts), int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * usual, size // BUCKET_BYTES)
    tokens = written_alone(pieces(texts, piece).mapInArrow(keep(buckets, part), f"part long, blob binary, docs array<{kind}>"), READ)
    question, answers = "part long, to long, blob binary", []
    for k in range(ROUNDS):
        asked = range(buckets * k // ROUNDS, buckets * (k + 1) // ROUNDS)
        asks = tokens.select("part", "blob").mapInArrow(ask(buckets, asked), question).repartition(usual, "to").sortWithinPartitions("to")
        answers.append(written_alone(asks.mapInArrow(answer, question + ", words long"), PARTS))
    answered = reduce(DataFrame.unionByName, answers)
    vocabulary = answered.agg(F.sum("words")).first()[0] or 0
    rows = tokens.select("part", F.lit(-1).cast("long").alias("to"), "blob", "docs").unionByName(answered.select("part", "to", "blob", F.lit(None).cast(f"array<{kind}>").alias("docs")))
    parts = rows.repartition(max(usual, size // (8 * BUCKET_BYTES)), "part").sortWithinPartitions("part", "to")
    return parts.mapInArrow(tell(buckets, vocabulary), f"doc_id {kind}, pos long, fwd double, bwd double")
