"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of BANDS bands with ROWS minhash values each are computed. The keys of the
BANDS x BANDS tables are pairs of a band of the first and a band of the second collection, so
BANDS squared tables cost 2 x BANDS bands. Documents that share a key are candidates. They are
dealt out by the first half of the key alone; the second half is compared inside. Where more than
CROWD nodes share a first half, they are dealt out by both halves, so that texts that are unlike
but for one half part again.

In a group, the document most like the others leads; it is paired with all that share a whole
key with it and whose signatures don't rule out the similarity; what it isn't paired with leads
in turn. Pairs are confirmed on full sets and components are formed by alternating stars. Then
candidates that stayed in different components are held against longer signatures; each one's
likeliest pair, then all pairs that are left, are confirmed as well and components formed again;
for the latter, members meet in tiles of a key's group, so no list of pairs is ever written.
A group whose members all are in one component gives no more pairs, so large groups of copies
give about one pair a member. Documents with equal sets are one node from the start.

Two documents at the threshold miss each other in all tables with a probability of 2e-5, less
the more alike they are; a true pair's signatures fall below LEAST by chance with 1e-7, its
longer ones below LONG_LEAST with 1e-6.

Defined results: null text counts as empty; texts without words have no shingles and are linked
with nothing. With fewer than SHINGLE words the whole sequence is the one shingle. Rows that
repeat a doc_id are in one component if their texts are linked. A null doc_id is never the
smallest unless a component has no other. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
BANDS, ROWS = 14, 2
HASHES = 2 * BANDS * ROWS
#: Bytes whose words are hashed at once.
GROUP = 1 << 20
#: Equal signature bytes of HASHES that a candidate needs.
LEAST = 25
#: Values of the longer signature that pairs across components are held against, and equal ones needed.
LONG, LONG_LEAST = 256, 159
#: Nodes that share a first half of a key and are still compared in one group.
CROWD = 2000
#: A part with more than this share of the documents is joined by broadcast, so fewer than HOT_SHARE parts are.
HOT_SHARE = 256
#: Members that a group's order of leaders is taken from.
SPREAD = 48
#: Members of a key that one task compares with as many others.
TILE = 4096
#: Members of a leader that one task confirms.
SHARE = 500
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SIGNED = "doc_id long, n_shingles long, node long, keys array<long>, sig binary"
_RNG = np.random.default_rng(17)
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACES = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SCALES = _RNG.integers(1, 1 << 63, (HASHES + LONG, 1), dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RNG.integers(1, 1 << 63, (HASHES + LONG, 1), dtype=np.uint64)
_K = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    out = []
    group, size = [], 0
    for text in [*texts, None]:
        if text is None or size + len(text) > GROUP:
            out += _sets(group) if group else []
            group, size = [], 0
        if text is not None:
            group.append(text)
            size += len(text) + 1
    return out


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    white = WHITE[data]
    edge = np.flatnonzero(np.diff(white, prepend=True))
    first, end = edge[0::2], edge[1::2]
    if not len(first):
        return [np.zeros(0, np.uint64)] * len(texts)
    length = end - first
    letters = np.flatnonzero(~white)
    place = letters - np.repeat(first, length)
    powers = np.multiply.accumulate(np.full(int(length.max()) + 1, _K | np.uint64(1)))
    sums = np.add.reduceat(_VALUES[data[letters]] * powers[place], np.concatenate([[0], np.cumsum(length)[:-1]]))
    words = mixed(sums + length.astype(np.uint64))
    stops = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(first, stops)
    rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        rolled += words[j: j + len(rolled)] * _PLACES[j]
    rolled = mixed(rolled)
    out = []
    for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a: b - SHINGLE + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * _PLACES[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhashes(hashes: np.ndarray, which: slice = slice(HASHES)) -> np.ndarray:
    """The least values of a set under some of the hash functions, 32 bits each."""
    scales, shifts = _SCALES[which], _SHIFTS[which]
    least = np.full(len(scales), np.iinfo(np.uint64).max)
    for a in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[None, a: a + (1 << 12)] * scales + shifts).min(1))
    return least >> np.uint64(32)


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: size, identity, band keys and signature of each text's set."""
    common.forget()
    salt = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        rows = []
        for hashes in shingle_sets(texts):
            if not len(hashes):
                rows.append((0, None, None, None))
                continue
            least = minhashes(hashes)
            pairs = least[: BANDS * ROWS].reshape(BANDS, ROWS)
            keys = mixed((pairs[:, 0] << np.uint64(32) | pairs[:, 1]) + salt * _K).view(np.int64)
            rows.append((len(hashes), node_of(hashes), keys, least.astype(np.uint8).tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").cast(pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
            pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.binary())],
            names=["doc_id", "n_shingles", "node", "keys", "sig"])


def sign_longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over texts of nodes: the longer signature."""
    for batch in batches:
        nodes, signs = [], []
        for who, hashes in zip(batch.column("who").to_pylist(), shingle_sets(batch.column("text").cast(pa.binary()).to_pylist()), strict=True):
            if len(hashes) and node_of(hashes) == who:
                nodes.append(who)
                signs.append(minhashes(hashes, slice(HASHES, None)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(signs, pa.binary())], names=["node", "long"])


def alike(sig: np.ndarray, size: np.ndarray, i: int, rows: slice | np.ndarray) -> np.ndarray:
    """Which of rows share a whole key with row i and aren't ruled out by signature or size."""
    same = sig[rows] == sig[i]
    keyed = same[:, BANDS * ROWS:].reshape(-1, BANDS, ROWS).all(2).any(1)
    low, high = np.minimum(size[rows], size[i]), np.maximum(size[rows], size[i])
    return keyed & (same.sum(1) >= LEAST) & (DENOMINATOR * low >= NUMERATOR * high)


def led_pairs(sig: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Leaders and their pairs; the member most like a spread of SPREAD others leads first, as an original does."""
    free = np.ones(len(sig), bool)
    some = np.unique(np.linspace(0, len(sig) - 1, SPREAD).astype(np.int64))
    central = np.zeros(len(sig), np.int64)
    for j in some.tolist():
        central += (sig == sig[j]).sum(1)
    for i in np.argsort(-central, kind="stable").tolist():
        if free[i]:
            like = alike(sig, size, i, slice(None))
            like[i] = False
            free[like] = False
            yield i, np.flatnonzero(like)


@dataclass
class Crossing:
    """What pairs across components need of a group's members, beside signature and size."""

    part: np.ndarray
    long: np.ndarray
    bands: np.ndarray
    band: int
    half: int = -1

    def first_met(self, sig: np.ndarray, i: int, rest: np.ndarray) -> np.ndarray:
        """Those of rest that share no earlier table with row i: a first half, or, dealt by both, a second half."""
        early = (self.bands[rest, : self.band] == self.bands[i, : self.band]).any(1)
        if self.half > 0:
            second = slice(BANDS * ROWS, BANDS * ROWS + ROWS * self.half)
            early |= (sig[rest, second] == sig[i, second]).reshape(len(rest), self.half, ROWS).all(2).any(1)
        return rest[~early]

    def still(self, i: int, rest: np.ndarray) -> np.ndarray:
        return rest[(self.long[rest] == self.long[i]).sum(1) >= LONG_LEAST]


def best_crossings(sig: np.ndarray, size: np.ndarray, of: Crossing) -> Iterator[tuple[int, np.ndarray]]:
    """For each member outside the largest component the member of another component that is most like it."""
    parts, where, counts = np.unique(of.part, return_inverse=True, return_counts=True)
    if len(parts) < 2:
        return
    for i in np.flatnonzero(where != counts.argmax()).tolist():
        rest = np.flatnonzero(of.part != of.part[i])
        rest = of.still(i, rest[alike(sig, size, i, rest)])
        if len(rest):
            yield i, rest[(of.long[rest] == of.long[i]).sum(1).argmax(keepdims=True)]


def all_crossings(sig: np.ndarray, size: np.ndarray, of: Crossing) -> Iterator[tuple[int, np.ndarray]]:
    """All pairs of members of different components that may be linked, in the first band that they share."""
    if (of.part == of.part[0]).all():
        return
    for i in range(len(sig)):
        rest = np.flatnonzero(of.part[i + 1:] != of.part[i]) + i + 1
        if len(rest):
            rest = of.still(i, rest[alike(sig, size, i, rest)])
            yield i, of.first_met(sig, i, rest)


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Crossing | None]]:
    """Key, nodes, signatures, sizes and what crossings need, of each key with several rows, from all rows of some keys."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    key, node = table["key"].to_numpy(), table["node"].to_numpy()
    order = np.lexsort((node, key))
    key, node, size = key[order], node[order], table["n_shingles"].to_numpy()[order]
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)[order]
    crossing = "part" in table.column_names
    if crossing:
        part, band, half = (table[c].to_numpy()[order] for c in ("part", "band", "half"))
        longer = np.frombuffer(b"".join(table["long"].to_pylist()), np.uint8).reshape(-1, LONG)[order]
        bands = np.concatenate([c.flatten().to_numpy() for c in table["keys"].chunks]).reshape(-1, BANDS)[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.concatenate([starts[1:], [len(key)]])
    large = ends - starts > 1
    for a, b in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
        of = Crossing(part[a:b], longer[a:b], bands[a:b], int(band[a]), int(half[a])) if crossing else None
        yield int(key[a]), node[a:b], sig[a:b], size[a:b], of


def pair_up(pairs_of, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over all rows of some keys: pairs (lead, node) to confirm, by one of the functions above."""
    leads, nodes, held = [], [], 0
    for _, node, sig, size, of in groups_of(batches):
        for i, like in pairs_of(sig, size, *(() if of is None else (of,))):
            if len(like):
                leads.append(np.full(len(like), node[i]))
                nodes.append(node[like])
                held += len(like)
        if held > 100_000:
            yield _pairs(leads, nodes)
            leads, nodes, held = [], [], 0
    if held:
        yield _pairs(leads, nodes)


def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over all rows of some keys: the members that have a pair left to confirm, by key.

    Members are dealt to tiles of TILE; each goes to every pair of tiles that its own is part of.
    """
    for key, node, sig, size, of in groups_of(batches):
        busy = np.zeros(len(node), bool)
        for i, like in all_crossings(sig, size, of):
            if len(like):
                busy[i] = True
                busy[like] = True
        own = node[busy]
        tiles = -(-len(own) // TILE)
        tile = np.arange(len(own)) // TILE
        rows = [(x, min(t, u), max(t, u), t) for x, t in zip(own.tolist(), tile.tolist(), strict=True) for u in range(tiles)]
        for a in range(0, len(rows), 20_000):
            columns = zip(*rows[a: a + 20_000], strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            parts = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            n = len(parts[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, of.band, np.int32)), pa.array(np.full(n, of.half, np.int32)), *parts], names=["block", "band", "half", "node", "low", "high", "tile"])


BLOCKS = "block long, band int, half int, node long, low int, high int, tile int"


def confirm_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over members and their texts by block and tiles: confirmed pairs."""
    names = ("block", "low", "high", "band", "tile", "node", "n_shingles", "sig", "long", "keys", "half", "part")
    held: list[tuple] = []
    at = None

    def settled() -> Iterator[pa.RecordBatch]:
        rows = [r for r in held if len(r[-1]) and node_of(r[-1]) == r[5]]
        if len(rows) < 2:
            return
        size, tile = np.array([r[6] for r in rows]), np.array([r[4] for r in rows])
        sig, longer = (np.frombuffer(b"".join([r[k] for r in rows]), np.uint8).reshape(len(rows), -1) for k in (7, 8))
        of = Crossing(np.array([r[11] for r in rows]), longer, np.array([r[9] for r in rows]), rows[0][3], rows[0][10])
        out = []
        for i, like in all_crossings(sig, size, of):
            if rows[0][1] != rows[0][2]:  # two tiles: pairs inside one are another task's
                like = like[tile[like] != tile[i]]
            out += [(rows[i][5], rows[j][5]) for j in like.tolist() if similar(rows[i][-1], rows[j][-1])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["lead", "node"])

    for batch in batches:
        sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist())
        for row in zip(*(batch.column(c).to_pylist() for c in names), sets, strict=True):
            if row[:3] != at:
                yield from settled()
                held, at = [], row[:3]
            held.append(row)
    yield from settled()


def _pairs(leads: list, nodes: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(leads)), pa.array(np.concatenate(nodes))], names=["lead", "node"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sorted sets are at least NUMERATOR / DENOMINATOR alike."""
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over texts sorted by target and salt, a leader before its members: confirmed pairs."""
    lead, at = None, None
    for batch in batches:
        target, salt, member, who = (batch.column(c).to_pylist() for c in ("target", "salt", "member", "who"))
        sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist())
        out = []
        for t, s, m, w, hashes in zip(target, salt, member, who, sets, strict=True):
            if not len(hashes) or node_of(hashes) != w:
                continue  # another row of that doc_id
            if not m:
                lead, at = hashes, (t, s)
            elif at == (t, s) and similar(lead, hashes):
                out.append((t, w))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["lead", "node"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets are alike; a leader with many members is compared in several tasks."""
    shares = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    members = pairs.join(shares, "lead").select(
        F.col("node").alias("who"), F.col("lead").alias("target"), F.pmod(F.xxhash64("node"), "shares").cast("int").alias("salt"), F.lit(True).alias("member"))
    leads = shares.select(F.col("lead").alias("who"), F.col("lead").alias("target"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(False).alias("member"))
    roles = members.unionByName(leads).join(texts, "who").select("target", "salt", "member", "who", "text")
    roles = roles.repartition(common.sized_partitions(pairs.sparkSession, texts, 2 << 20), "target", "salt").sortWithinPartitions("target", "salt", "member")
    return roles.mapInArrow(confirm, "lead long, node long")


def components(links: DataFrame) -> DataFrame:
    """node and part (the least node reachable) of all nodes in links, by alternating stars."""
    turned = F.greatest("lead", "node").alias("u"), F.least("lead", "node").alias("v")
    edges = common.materialise(links.select(*turned).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        # every node's larger neighbours join the least of its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # every node and its smaller neighbours join the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = common.materialise(small.filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("part"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("part")).distinct())


def crowded_keys(nodes: DataFrame) -> DataFrame | None:
    """First halves that more than CROWD nodes share; None if there are none."""
    counted = nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = common.materialise(counted.filter(F.col("n") > CROWD).select("key", F.lit(True).alias("crowd")), "crowded")
    return None if found.isEmpty() else found


def halved(rows: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """Rows by key and half -1; those of a crowded first half once for each second half, with its number and a key of both."""
    rows = rows.withColumn("half", F.lit(-1))
    if crowded is None:
        return rows
    rows = rows.join(crowded, "key", "left")
    calm = rows.filter(F.col("crowd").isNull()).drop("crowd")
    dealt = rows.filter(F.col("crowd")).drop("crowd").withColumn("half", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
    second = F.expr(f"substring(sig, {BANDS * ROWS + 1} + {ROWS} * half, {ROWS})")
    return calm.unionByName(dealt.withColumn("key", F.xxhash64("key", "half", second)))


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; docs has doc_id and text (not null)."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    signed = common.materialise(docs.select("doc_id", "text").mapInArrow(sign, SIGNED), "signatures")
    nodes = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "n_shingles", "keys", "sig")).alias("r"))
    nodes = common.materialise(nodes.select("node", "r.*"), "nodes")
    parts = common.sized_partitions(spark, nodes, 1 << 20)

    ordered = F.least("lead", "node").alias("lead"), F.greatest("lead", "node").alias("node")

    crowded = crowded_keys(nodes)

    def keyed(rows: DataFrame) -> DataFrame:
        if "part" not in rows.columns:
            return halved(rows.select(F.posexplode("keys").alias("band", "key"), "node", "n_shingles", "sig"), crowded).repartition(parts, "key")
        # only keys whose members are in several components have pairs left
        slim = halved(rows.select(F.posexplode("keys").alias("band", "key"), "node", "part", "sig"), crowded).drop("sig")
        split = slim.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("key")
        left = slim.join(split, "key").groupBy("node").agg(F.collect_list(F.struct("band", "half", "key")).alias("at"))  # at most BANDS squared a node
        return rows.join(left, "node").select(F.explode("at").alias("at"), "node", "n_shingles", "sig", "part", "long", "keys").select("at.*", "node", "n_shingles", "sig", "part", "long", "keys").repartition(parts, "key")

    def paired(rows: DataFrame, pairs_of) -> DataFrame:
        return keyed(rows).mapInArrow(partial(pair_up, pairs_of), "lead long, node long").distinct()

    pairs = common.materialise(paired(nodes, led_pairs), "pairs")
    involved = pairs.select("lead").union(pairs.select("node")).distinct().withColumnRenamed("lead", "node")
    wanted = nodes.join(involved, "node").select(F.col("node").alias("who"), F.col("doc_id").alias("of_id"))
    texts = common.materialise(docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["of_id"])).select("who", "text"), "texts")
    links = common.materialise(confirmed(pairs, texts), "links")
    found = components(links)
    longer = texts.mapInArrow(sign_longer, "node long, long binary").dropDuplicates(["node"])
    longer = common.materialise(nodes.join(longer, "node"), "longer")

    def parted() -> DataFrame:
        return longer.join(found, "node", "left").withColumn("part", F.coalesce("part", "node"))

    likeliest = paired(parted(), best_crossings).select(*ordered).distinct().join(pairs.select(*ordered), ["lead", "node"], "left_anti")
    more = common.materialise(confirmed(common.materialise(likeliest, "pairs"), texts), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        found = components(links)
    known = common.materialise(parted(), "parted")
    blocks = common.materialise(keyed(known).mapInArrow(open_blocks, BLOCKS), "blocks")
    members = blocks.join(known.join(texts, F.col("node") == F.col("who")), "node")
    members = members.repartition(parts, "block", "low", "high").sortWithinPartitions("block", "low", "high", "node")
    more = common.materialise(members.mapInArrow(confirm_blocks, "lead long, node long"), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    # a node without links is a component of its own; texts without words have no node
    none = signed.filter(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    of_node = signed.filter(F.col("node").isNotNull()).select("doc_id", "n_shingles", "node").join(found, "node", "left").withColumn("part", F.coalesce("part", "node"))
    of_node = common.materialise(of_node, "parts")
    least = common.materialise(of_node.groupBy("part").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    rows = least.agg(F.sum("n")).first()[0] or 0
    large = F.broadcast(least.filter(F.col("n") > rows // HOT_SHARE).drop("n"))
    small = least.filter(F.col("n") <= rows // HOT_SHARE).drop("n")
    done = of_node.join(large, "part")
    rest = of_node.join(large.select("part"), "part", "left_anti").join(small, "part")
    told = done.unionByName(rest).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return told.unionByName(none)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.keyed_texts(common.read(spark, sf_dir, "documents"))
    return linked(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one document of each component, with docs' own columns."""
    found = linked(common.keyed_texts(docs))
    return common.without(docs, found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT c.a, c.b FROM c JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b WHERE 100 * c.k >= 75 * (na.n + nb.n - c.k)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.a, r.m FROM r JOIN l ON l.b = r.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.m) AS component_id, n.doc_id = min(r.m) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
