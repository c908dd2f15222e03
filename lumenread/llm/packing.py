"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents become pieces of at most the capacity; pieces are packed by bulk-synchronous best fit.
Because lengths are integers up to the capacity, the sorted tables of pieces and gaps are kept as
runs: pieces of one length and consecutive ranks, sequences of one gap and consecutive numbers.
Pieces are counted, ranked and given their places where they are, in parallel; of runs there are
at most a few a length and superstep, whatever the input.

First, pieces longer than half the capacity open a sequence each. Then, in each superstep, the runs
of unplaced pieces and of gaps are range-partitioned by size; every range is swept from its longest
pieces down, a piece taking its successor, the smallest gap of the range that holds it. Pieces that
want the same gaps get them by rank, the longest first; gaps are updated, and what is left goes on
to the next superstep with ranges twice as wide: a piece's successor is looked for among the
nearest sizes first, and a gap that a range holds is too small for the pieces of any higher one.
In the last superstep there is one range; pieces that still find no gap open new sequences there.

Defined results: a null text counts as empty and is its end id alone. Rows that repeat are
packed as often as they occur. Ties are ordered by doc_id and piece. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .word_merges import PLAIN, WordMerges

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that are ranked together, so that a common length isn't one task.
RANKED = 1000
#: Size ranges of the first superstep; each further one has half as many.
RANGES = 16
#: Chunks that a worker remembers.
CACHE = 1_000_000


class ChunkIds:
    """Ids of chunks without blanks, as little-endian unsigned 32-bit integers; frequent ones are remembered.

    Unknown chunks of a batch are merged together where they are plain words; the tokenizer
    itself encodes the others.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.merges = Tokenizer.from_file(tokenizer_file), WordMerges(tokenizer_file)
        self.batch: dict[str, bytes] = {}  # what the batch at hand needs and isn't remembered
        self.marks = common.Filled(self.encode, 10_000)
        self.known = common.Filled(self.batch.__getitem__, CACHE)
        self.known[""] = b""

    def encode(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: set[str]) -> None:
        plain: list[tuple[str, str]] = []
        words: dict[str, int] = {}
        self.batch.clear()
        for chunk in chunks:
            if parts := PLAIN.fullmatch(chunk):
                words.setdefault(parts[1].lower(), len(words))
                plain.append((chunk, parts))
            else:
                self.batch[chunk] = self.encode(chunk)
        ids = self.merges.ids(list(words))
        for chunk, parts in plain:
            own = ids[words[parts[1].lower()]]
            self.batch[chunk] = own + self.marks[parts[2]] if parts[2] else own

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text.

        The tokenizer drops white space and never joins what it separates, so a text's ids are
        the ids of its chunks between blanks; other white space stays inside a chunk.
        """
        lists = [text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for text in texts]
        self.learn(set().union(*lists).difference(self.known))
        for chunks in lists:
            yield b"".join(map(self.known.__getitem__, chunks))


def known_chunks(tokenizer_file: str) -> ChunkIds:
    return common.kept(("chunks", tokenizer_file), lambda: ChunkIds(tokenizer_file))


def cut(tokenizer_file: str, capacity: int, end_id: int):
    """A function for mapInArrow: the pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_chunks(tokenizer_file)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for ids, texts in common.documents_of(batches):
            rows = []
            for doc_id, own in zip(ids, known.texts(texts), strict=True):
                raw = own + end
                rows += [(doc_id, k, a // 4, len(part := raw[a:a + step]) // 4, zlib.crc32(part)) for k, a in enumerate(range(0, len(raw), step))]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    common.bound_batches(docs.sparkSession)
    return common.keyed_texts(docs).mapInArrow(cut(tokenizer_file, capacity, end_id), PIECES)


Run = tuple[int, int, int]


def sweep(pieces: list[Run], gaps: list[Run], capacity: int = CAPACITY, fresh: int | None = None) -> tuple[list[tuple[int, int, int, int, int, int]], list[Run], list[Run]]:
    """Best fit of runs of pieces (length, first rank, end rank) into runs of gaps (size, first sequence, end sequence).

    Gives places (length, first rank, end rank, first sequence, pieces a sequence, offset) and the
    runs that are left. The piece of rank r goes to sequence first + (r - first rank) // m, at
    offset + (r - first rank) % m * length. With fresh, pieces that find no gap open sequences from that number on.
    """
    sizes: list[int] = []  # of open gaps, ascending
    open_: dict[int, list[tuple[int, int]]] = {}  # by gap: runs (first sequence, end)
    places: list[tuple[int, int, int, int, int, int]] = []
    left: list[Run] = []

    def leave(gap: int, first: int, end: int) -> None:
        if gap and first < end:
            if gap not in open_:
                insort(sizes, gap)
                open_[gap] = []
            open_[gap].append((first, end))

    for run in sorted(gaps, reverse=True):
        leave(*run)
    for length, rank, end in sorted(pieces, key=lambda r: (-r[0], r[1])):
        while rank < end:
            at = bisect_left(sizes, length)  # the successor: the smallest gap that holds this length
            if at < len(sizes):
                gap = sizes[at]
                first, stop = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    sizes.pop(at)
            elif fresh is None:
                left.append((length, rank, end))
                break
            else:
                gap, first = capacity, fresh
                fresh = stop = first - (rank - end) // (capacity // length)
            each = gap // length
            full, more = divmod(min(end - rank, (stop - first) * each), each)
            placed = full * each + more
            places.append((length, rank, rank + placed, first, each, capacity - gap))
            leave(gap - each * length, first, first + full)
            leave(gap - more * length, first + full, first + full + 1 if more else first + full)
            leave(gap, first + full + bool(more), stop)
            rank += placed
    return places, left, [(gap, *run) for gap in sizes for run in open_[gap]]


PIECE, GAP, PLACE = 0, 1, 2
RUNS = "kind int, size long, first long, end long, first_sequence long, each long, offset long"


def sweep_ranges(capacity: int, fresh: int | None):
    """For mapInArrow over the runs of some ranges, range by range: places, and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("range", "kind", "size", "first", "end")), strict=True)]
        out: list[tuple] = []
        for _, own in groupby(rows, key=lambda r: r[0]):
            runs: dict[int, list[Run]] = {PIECE: [], GAP: []}
            for _, kind, *one in own:
                runs[kind].append(tuple(one))
            places, left, gaps = sweep(runs[PIECE], runs[GAP], capacity, fresh)
            out += [(PLACE, *p) for p in places] + [(PIECE, *x, None, None, None) for x in left] + [(GAP, *x, None, None, None) for x in gaps]
        columns = zip(*out, strict=True) if out else [()] * 7
        kinds = (pa.int32(), *[pa.int64()] * 6)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split(" ")[0] for x in RUNS.split(", ")])

    return run


def opened(counts: DataFrame, capacity: int) -> DataFrame:
    """Runs after the pieces longer than half the capacity opened a sequence each, numbered by length; counts: length, n."""
    nothing = F.lit(None).cast("long")
    small = counts.filter(2 * F.col("length") <= capacity)
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a length
    large = counts.filter(2 * F.col("length") > capacity).withColumn("number", before)
    zero = F.lit(0).cast("long")
    rows = [
        small.select(F.lit(PIECE).alias("kind"), F.col("length").alias("size"), zero.alias("first"), F.col("n").alias("end"), nothing.alias("first_sequence"), nothing.alias("each"), nothing.alias("offset")),
        large.filter(F.col("length") < capacity).select(F.lit(GAP).alias("kind"), (capacity - F.col("length")).alias("size"), F.col("number").alias("first"), (F.col("number") + F.col("n")).alias("end"), nothing, nothing, nothing),
        large.select(F.lit(PLACE).alias("kind"), F.col("length").alias("size"), zero.alias("first"), F.col("n").alias("end"), F.col("number").alias("first_sequence"), F.lit(1).cast("long").alias("each"), zero.alias("offset"))]
    return rows[0].union(rows[1]).union(rows[2])


def places_of(counts: DataFrame, capacity: int = CAPACITY, ranges: int = RANGES) -> DataFrame:
    """The places of all pieces, as runs, from the number of pieces of each length."""
    state = common.materialise(opened(counts, capacity), "runs")
    fresh = counts.filter(2 * F.col("length") > capacity).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = [state.filter(F.col("kind") == PLACE)]
    while ranges:
        runs = state.filter(F.col("kind") != PLACE).withColumn("range", F.floor(F.col("size") * ranges / (capacity + 1)).cast("int"))
        step = runs.repartition("range").sortWithinPartitions("range", "kind", "size", "first")
        state = common.materialise(step.mapInArrow(sweep_ranges(capacity, fresh if ranges == 1 else None), RUNS), "runs")
        found.append(state.filter(F.col("kind") == PLACE))
        ranges //= 2
    return reduce(DataFrame.unionByName, found).drop("kind")


def pack(pieces: DataFrame, capacity: int = CAPACITY, ranges: int = RANGES) -> DataFrame:
    """pieces (with doc_id, piece, length) and the sequence_id and offset of each."""
    pieces = common.materialise(pieces, "pieces")
    lengths = common.materialise(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")  # at most capacity rows
    places = F.broadcast(places_of(lengths, capacity, ranges).withColumnRenamed("size", "length"))  # some a length and superstep
    shares = F.broadcast(lengths.select("length", F.ceil(F.col("n") / RANKED).cast("int").alias("shares")))
    salted = pieces.join(shares, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), "shares").cast("int")).drop("shares")
    counted = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = counted.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("local", F.row_number().over(within)).join(bases, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("local") - 1)
    placed = ranked.join(places, ["length"]).filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(pieces_of(docs, tokenizer_file, capacity, end_id), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
