"""Removal of every byte that a repeated string of LENGTH bytes covers, by suffix sorting.

Sorting all suffixes would move each text a hundred times over, so suffixes are sampled by
content: each window of LENGTH bytes is owned by the place in it whose KEY bytes hash least
(the leftmost such place). Equal windows are owned at equal offsets, so a repeated window always
shows as two sampled suffixes that agree in their KEY leading bytes.

1. Every text gives its sampled suffixes: a hash of the leading bytes, and a 128-bit hash of all
   bytes that the windows it owns cover. Rows that agree in both are repeats as a whole. Leading
   bytes that one hashing group already has in several contexts have to be compared anyway, so their
   suffixes are dealt out by the whole hash, and only word of them goes to their key's task.
2. Suffixes that agree in the leading bytes but not in all are cut out with their contexts.
   Sampled splitters range-partition them by their leading bytes; a bucket sorts its suffixes by
   multikey quicksort and the left contexts, read backwards, alike; what neighbours share tells
   for each owned window whether it has an equal. Splitters compare KEY bytes and a window's
   owner shares at least these with its equal, so neighbours across a boundary share less than
   any repeat needs; no repeat is lost there. Leading bytes with more than HOT contexts to
   compare are dealt out by window instead and counted.
3. Repeated windows meet their text, are merged to spans and cut out.

Defined results: null text counts as empty and loses nothing. Matches lie inside documents; rows
that repeat are documents of their own, so both lose what they share. Rows of one doc_id, or none, are
told apart by 128 bits of their texts' hash; such rows with one text lose the same. A text shorter than LENGTH
bytes stays whole. Other columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, KEY = 200, 64
REACH = LENGTH - KEY  # a window's owner starts at most so many bytes after the window
#: Bytes that are hashed at once, and contexts of one key that one task compares.
SEGMENT, HOT = 1 << 20, 20_000
#: A row to ask about, one that is known to repeat, one to compare in any case, and word of these to their key.
KIND_ASK, KIND_KNOWN, KIND_APART, KIND_WORD = 0, 1, 2, 3
SUFFIXES = "kind byte, key long, whole binary, many boolean, doc_id long, tag binary, at int, first int, last int"
FOUND = "kind byte, many boolean, doc_id long, tag binary, at int, first int, last int"

_BASE = np.uint64(0x9FB21C651E98DF25)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Sampler:
    """Owners of all windows of a byte string."""

    def __init__(self, seed: int = 5):
        self.values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            for name, by in (("up", _BASE), ("down", inverse)):
                out = np.full(n, by, np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))

    def owners(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, its key hash, first and last owned window start, in strings that end at ends one after the other."""
        n = len(data)
        if n < LENGTH:
            return (np.zeros(0, np.int64),) * 4
        self.powers(n + 1)
        # a polynomial over KEY bytes from sums of bytes times powers
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=total[1:])
        places = n - KEY + 1
        keys = (total[KEY:] - total[:places]) * self.down[:places]
        keys ^= keys >> np.uint64(32)
        keys *= _MIX
        keys ^= keys >> np.uint64(29)
        order = (keys & ~np.uint64(0xFFFFFFFF)) | np.arange(places, dtype=np.uint64)
        # least of REACH + 1 neighbours: running minima from block starts and from block ends
        w = REACH + 1
        padded = np.full(-(-places // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[:places] = order
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
        count = n - LENGTH + 1
        least = np.minimum(behind[:count], ahead[w - 1: w - 1 + count])
        starts = np.arange(count)
        last_of = ends[np.searchsorted(ends, starts, side="right")] - LENGTH  # of a window's string
        inside = starts <= last_of
        starts, owner = starts[inside], (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if not len(starts):
            return (np.zeros(0, np.int64),) * 4
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
        return owner[new], keys[owner[new]].view(np.int64), starts[new], starts[last]


def segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Groups of (document, first place, offset, bytes) of about SEGMENT bytes.

    A part of a long text answers for the SEGMENT places from its first one on, and has the bytes of
    all windows that these can own, so no place's windows are dealt to two parts.
    """
    group, size = [], 0
    for d, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for a in range(0, len(text) - KEY + 1, SEGMENT):
            begin = max(0, a - REACH)
            part = text[begin: a + SEGMENT + LENGTH - 1]
            if size + len(part) > 2 * SEGMENT and group:
                yield group
                group, size = [], 0
            group.append((d, a, begin, part))
            size += len(part)
    if group:
        yield group


def sample_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: suffixes to ask about, and those that their own batch shows to be repeats."""
    common.forget()
    sampler = Sampler()
    for batch in batches:
        ids, tags = batch.column("doc_id"), batch.column("tag")
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for group in segments(texts):
            data = b"".join(part for *_, part in group)
            ends = np.cumsum([len(part) for *_, part in group])
            owner, key, first, last = sampler.owners(np.frombuffer(data, np.uint8), ends)
            which = np.searchsorted(ends, first, side="right")
            begin = ends - [len(part) for *_, part in group]
            offset = (np.array([x for _, _, x, _ in group]) - begin)[which]
            place = owner + offset - np.array([a for _, a, _, _ in group])[which]
            own = np.flatnonzero((place >= 0) & (place < SEGMENT))
            if not len(own):
                continue
            owner, key, first, last, which, offset = (x[own] for x in (owner, key, first, last, which, offset))
            whole = [xxhash.xxh3_128_digest(data[a: b + LENGTH] + bytes((m - a,))) for m, a, b in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True)]
            sums = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
            order = np.lexsort((sums[:, 1], sums[:, 0], key))
            same = (key[order][1:] == key[order][:-1]) & (sums[order][1:] == sums[order][:-1]).all(1)
            later, earlier = np.concatenate([[False], same]), np.concatenate([same, [False]])
            known, ask = order[later | earlier], order[~later]
            many = earlier[~later]
            # keys with several contexts here
            asked = key[ask]
            new_key = np.concatenate([[True], asked[1:] != asked[:-1]])
            of = np.cumsum(new_key) - 1
            apart = (np.bincount(of) > 1)[of]
            word = ask[new_key & apart]
            row = np.concatenate([known, ask, word])
            to = key[row]
            # what is known already goes anywhere: a key with very many copies isn't one task's
            to[: len(known)] ^= np.arange(len(known)) * np.int64(0x9E3779B97F4A7C1)
            to[len(known): len(known) + len(ask)] ^= np.where(apart, sums[ask, 0] ^ sums[ask, 1], 0)
            kind = np.concatenate([np.full(len(known), KIND_KNOWN), np.where(apart, KIND_APART, KIND_ASK), np.full(len(word), KIND_WORD)]).astype(np.int8)
            doc = np.array([d for d, *_ in group])[which[row]]
            yield pa.RecordBatch.from_arrays([
                pa.array(kind), pa.array(to), pa.array([None] * len(known) + [whole[i] for i in ask.tolist()] + [None] * len(word), pa.binary()),
                pa.array(np.concatenate([np.zeros(len(known), bool), many, np.zeros(len(word), bool)])),
                ids.take(pa.array(doc)).cast(pa.int64()), tags.take(pa.array(doc)),
                *(pa.array((x[row] + offset[row]).astype(np.int32)) for x in (owner, first, last))],
                names=["kind", "key", "whole", "many", "doc_id", "tag", "at", "first", "last"])


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over all suffixes of some keys: known repeats, and contexts that must be compared."""
    kept, told = [], []
    names = ["kind", "many", "doc_id", "tag", "at", "first", "last"]
    for batch in batches:
        kind = batch.column("kind")
        known = batch.filter(pc.equal(kind, KIND_KNOWN))
        if known.num_rows:
            yield known.select(names)
        told.append(batch.filter(pc.equal(kind, KIND_WORD)).column("key").to_numpy())
        kept.append(batch.filter(pc.is_in(kind, pa.array([KIND_ASK, KIND_APART], pa.int8()))))
    if not kept or not (table := pa.Table.from_batches(kept)).num_rows:
        return
    table = table.combine_chunks()
    key, many = table["key"].to_numpy(), table["many"].to_numpy()
    must = (table["kind"].to_numpy() == KIND_APART) | np.isin(key, np.concatenate(told))
    sums = np.frombuffer(b"".join(table["whole"].to_pylist()), np.int64).reshape(-1, 2)
    order = np.lexsort((sums[:, 1], sums[:, 0], key))
    key, sums, must = key[order], sums[order], must[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = new_key | np.concatenate([[True], (sums[1:] != sums[:-1]).any(1)])
    of = np.cumsum(new) - 1
    repeats = (np.bincount(of) > 1) | np.bincount(of, many[order]).astype(bool)
    contexts = np.bincount(np.cumsum(new_key) - 1, new)[np.cumsum(new_key) - 1]
    known = repeats[of]
    must = np.bincount(of, must)[of] > 0
    compare = new & ((contexts > 1) | must)
    for rows, kind in ((np.flatnonzero(known), KIND_KNOWN), (np.flatnonzero(compare), KIND_ASK)):
        part = table.take(pa.array(order[rows]))
        columns = {c: part[c] for c in names} | {"kind": pa.array(np.full(len(rows), kind, np.int8)), "many": pa.array(known[rows])}
        yield from pa.table({c: columns[c] for c in names}).to_batches(max_chunksize=50_000)


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over documents with their asked suffixes: the bytes to compare."""
    for batch in batches:
        rows = []
        for doc_id, tag, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text", "asked")), strict=True):
            data = text.encode()
            for x in asked:
                at = x["at"]
                rows.append((x["many"], doc_id, tag, at, x["first"], x["last"], data[at: at + LENGTH], data[max(0, at - REACH): at]))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = (pa.bool_(), pa.int64(), batch.schema.field("tag").type, pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["many", "doc_id", "tag", "at", "first", "last", "right", "left"])
        for a in range(0, whole.num_rows, 10_000):
            yield whole.slice(a, 10_000)


CONTEXTS = "many boolean, doc_id long, tag binary, at int, first int, last int, right binary, left binary"
SPANS = "doc_id long, tag binary, first int, last int"


def padded(strings: list[bytes], width: int) -> np.ndarray:
    """Rows of width bytes, zeros after each string's end."""
    return np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), np.uint8).reshape(-1, width)


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, and how many leading bytes each shares with the one before in that order.

    Multikey quicksort by eight bytes at a time: rows are ordered by the first eight, then
    only ties by the next eight, and so on.
    """
    n, width = rows.shape
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -width % 8)))).view(">u8").astype(np.uint64)
    order, tied, tie = np.arange(n), np.arange(n), np.zeros(n, np.int64)
    for k in range(words.shape[1]):
        if not len(tied):
            break
        word = words[order[tied], k]
        by = np.lexsort((word, tie))
        order[tied] = order[tied[by]]
        word, tie = word[by], tie[by]
        apart = np.concatenate([[True], (word[1:] != word[:-1]) | (tie[1:] != tie[:-1])])
        tie = np.cumsum(apart)
        alone = apart & np.concatenate([apart[1:], [True]])
        tied, tie = tied[~alone], tie[~alone]
    shared = np.zeros(n, np.int64)
    for a in range(1, n, 20_000):
        b = min(n, a + 20_000)
        differ = rows[order[a:b]] != rows[order[a - 1:b - 1]]
        shared[a:b] = np.where(differ.any(1), differ.argmax(1), width)
    return order, shared


def repeated_windows(rights: list[bytes], lefts: list[bytes], at: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """(row, window start) of every owned window that equals a window of another row."""
    n = len(rights)
    size_r, size_l = np.array([len(x) for x in rights]), np.array([len(x) for x in lefts])
    right_order, right_shared = multikey_sort(padded(rights, LENGTH))
    left_order, left_shared = multikey_sort(padded([x[::-1] for x in lefts], REACH))
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    out = []
    for a in range(REACH + 1):  # a window that starts a bytes before its owner
        able = np.flatnonzero((size_l >= a) & (size_r >= LENGTH - a))
        if len(able) < 2:
            continue
        right_class[right_order] = np.cumsum(right_shared < LENGTH - a)
        left_class[left_order] = np.cumsum(left_shared < a) if a else 0
        both = right_class[able] * (n + 1) + left_class[able]
        by = np.argsort(both, kind="stable")
        same = both[by][1:] == both[by][:-1]
        rows = able[by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        rows = rows[(first[rows] <= at[rows] - a) & (at[rows] - a <= last[rows])]
        out += zip(rows.tolist(), (at[rows] - a).tolist(), strict=True)
    return out


def compare_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over a bucket of suffixes: spans of repeated windows of those that weren't known."""
    # leading bytes ascend, so a bucket is compared in parts that no key crosses
    waiting: list[pa.RecordBatch] = []
    rows, tail = 0, b""
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= 60_000:
            table = pa.Table.from_batches(waiting).combine_chunks()
            rights = table["right"].to_pylist()
            tail, cut = rights[-1][:KEY], len(rights) - 1
            while cut and rights[cut - 1][:KEY] == tail:
                cut -= 1
            if cut:
                yield from compared(table.slice(0, cut))
                waiting = table.slice(cut).combine_chunks().to_batches()
                rows = len(rights) - cut
    if rows:
        yield from compared(pa.Table.from_batches(waiting).combine_chunks())


def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
    at, first, last = (table[c].to_numpy() for c in ("at", "first", "last"))
    found = repeated_windows(table["right"].to_pylist(), table["left"].to_pylist(), at, first, last)
    many = table["many"].to_numpy()
    rows, starts = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    fresh = ~many[rows]
    rows, starts = rows[fresh], starts[fresh]
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    if len(rows):
        new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        end = np.concatenate([new[1:] - 1, [len(rows) - 1]])
        of = pa.array(rows[new])
        yield pa.RecordBatch.from_arrays([
            table["doc_id"].take(of).combine_chunks(), table["tag"].take(of).combine_chunks(),
            pa.array(starts[new].astype(np.int32)), pa.array(starts[end].astype(np.int32))], names=["doc_id", "tag", "first", "last"])


def dealt_by_window(hot: DataFrame) -> DataFrame:
    """Repeated windows of keys with very many contexts: a row for each owned window, counted by its bytes."""
    start = F.explode(F.sequence("first", "last"))
    windows = hot.withColumn("start", start).withColumn("before", F.col("at") - F.col("start"))
    string = F.concat(F.expr("substring(left, length(left) - before + 1, before)"), F.expr(f"substring(right, 1, {LENGTH} - before)"))
    windows = windows.select("doc_id", "tag", "start", "many", F.sha2(string, 256).alias("window"))
    # a known context is there once for all its copies
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
    return windows.filter(~F.col("many")).join(twice, "window", "left_semi").select("doc_id", "tag", F.col("start").alias("first"), F.col("start").alias("last"))


def tag() -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.unhex(F.md5("text"))


def same_row(other: DataFrame, docs: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(other["of_id"]) & (docs["tag"] == other["of_tag"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tag and arrays of (first, last) starts of repeated windows; docs has doc_id, text (not null) and tag."""
    spark = docs.sparkSession
    parts = common.sized_partitions(spark, docs)
    found = docs.mapInArrow(sample_suffixes, SUFFIXES).repartition(parts, "key").mapInArrow(settle, FOUND)
    found = common.materialise(found, "suffixes")
    spans = found.filter(F.col("kind") == KIND_KNOWN).select("doc_id", "tag", "first", "last")
    asked = found.filter(F.col("kind") == KIND_ASK).groupBy(F.col("doc_id").alias("of_id"), F.col("tag").alias("of_tag")).agg(
        F.collect_list(F.struct("many", "at", "first", "last")).alias("asked"))
    contexts = docs.join(asked, same_row(asked, docs)).select("doc_id", "tag", "text", "asked").mapInArrow(cut_contexts, CONTEXTS)
    contexts = common.materialise(contexts.withColumn("lead", F.substring("right", 1, KEY)), "contexts")
    hot = common.materialise(contexts.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("lead"), "hot")
    calm = contexts
    if not hot.isEmpty():
        calm = contexts.join(hot, "lead", "left_anti")
        spans = spans.unionByName(dealt_by_window(contexts.join(hot, "lead", "left_semi")))
    calm = calm.repartitionByRange(common.sized_partitions(spark, contexts), "lead").sortWithinPartitions("lead")
    spans = spans.unionByName(calm.drop("lead").mapInArrow(compare_bucket, SPANS))
    return spans.groupBy(F.col("doc_id").alias("of_id"), F.col("tag").alias("of_tag")).agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def keep_rest(data: bytes, spans: list | None) -> tuple[bytes, int]:
    """What is left of data, and the number of maximal runs removed."""
    if spans is None or not len(spans):
        return data, 0
    covered = sorted((x["first"], x["last"] + LENGTH) for x in spans)
    out, end, runs = [], 0, 0
    stop = None
    for a, b in covered:
        if stop is None or a > stop:
            runs += 1
            out.append(data[end:a])
        stop = b if stop is None else max(stop, b)
        end = stop
    out.append(data[end:])
    return b"".join(out), runs


def cut_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            data = text.encode()
            rest, runs = keep_rest(data, spans)
            rows.append((doc_id, len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def with_spans(docs: DataFrame) -> DataFrame:
    common.bound_batches(docs.sparkSession)
    spans = repeated_spans(docs.select("doc_id", "tag", "text"))
    return docs.join(spans, same_row(spans, docs), "left").drop("of_id", "of_tag")


def digests(docs: DataFrame) -> DataFrame:
    keyed = common.keyed_texts(docs).withColumn("tag", tag())
    return with_spans(keyed).select("doc_id", "text", "spans").mapInArrow(
        cut_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with what repeats cut out of text, and n_chars, where there is one, counted anew.

    Characters of which only some bytes are left go as a whole. A null text stays null.
    """
    names = docs.columns
    others = [c for c in names if c != "text"]
    slim = docs.select(F.struct(F.lit(0).alias("__0"), *[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").isNull().alias("none"), "doc_id", common.text_or_empty().alias("text"))
    together = with_spans(slim.withColumn("tag", tag()))

    @F.pandas_udf("string")
    def rest(text, spans):
        return text.combine(spans, lambda t, s: keep_rest(t.encode(), s)[0].decode("utf-8", "ignore"))

    left = F.when(F.col("spans").isNotNull(), rest("text", "spans")).when(~F.col("none"), F.col("text"))
    cut = together.select("row", left.alias("__text"))
    n_chars = F.coalesce(F.length("__text"), F.lit(0))
    return cut.select(*[
        F.col("__text").alias(c) if c == "text" else n_chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents"))


SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(generate_series(0, CAST(length(h) // 2 AS BIGINT) - 200)) AS i FROM h WHERE length(h) >= 400),
m AS (SELECT w.doc_id, w.i, md5(substr(h.h, 2 * w.i + 1, 400)) AS m FROM w JOIN h USING (doc_id)),
t AS (SELECT m FROM m GROUP BY m HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM m WHERE m IN (SELECT m FROM t)),
b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM n GROUP BY doc_id, run),
g AS (SELECT s.doc_id, s.a, s.z, substr(h.h, 2 * lag(s.z, 1, 0) OVER (PARTITION BY s.doc_id ORDER BY s.a) + 1, 2 * (s.a - lag(s.z, 1, 0) OVER (PARTITION BY s.doc_id ORDER BY s.a))) AS part FROM s JOIN h USING (doc_id)),
k AS (SELECT doc_id, string_agg(part, '' ORDER BY a) AS head, max(z) AS last, sum(z - a) AS gone, count(*) AS spans FROM g GROUP BY doc_id)
SELECT h.doc_id, CAST(length(h.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h.h ELSE k.head || substr(h.h, 2 * k.last + 1) END)) AS kept_sha256
FROM h LEFT JOIN k ON k.doc_id = h.doc_id
"""
