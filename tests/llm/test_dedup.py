import hashlib
import re
from collections import Counter, defaultdict

from helpers import cases, clashing, frame, prose, repeated
from lumenread.llm import exact_dedup, minhash_dedup, suffix_dedup

import numpy as np
import pytest


def exact_brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    groups = defaultdict(list)
    for (i, *_), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    out, seen = [], set()
    for (i, *_), t in zip(rows, norm, strict=True):
        known = [x for x in groups[t] if x is not None]
        keep = min(known) if known else None
        kept = i == keep and (i, t) not in seen
        seen.add((i, t))
        out.append((i, keep, len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [cases(), repeated(), []], ids=["cases", "repeated", "empty"])
def test_exact(spark, rows):
    found = exact_dedup.fresh_index(spark, 2).ingest(clashing(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted([tuple(r) for r in found.collect()], key=str) == exact_brute(rows)


def test_index_persists(spark):
    index = exact_dedup.fresh_index(spark, 2)
    index.ingest(frame(spark, [(5, "a b", "en", "s", 3)])).collect()
    again = {r["doc_id"]: (r["keep_id"], r["kept"], r["group_size"]) for r in index.ingest(frame(spark, [(1, "a  b", "en", "s", 4), (2, "new", "en", "s", 3)])).collect()}
    assert again == {1: (5, False, 2), 2: (2, True, 1)}
    assert index.read().count() == 2


def test_index_counts_every_batch(spark):
    index = exact_dedup.fresh_index(spark, 2)
    told = [[tuple(r) for r in index.ingest(frame(spark, [(i, t, "en", "s", 3) for i, t in rows])).select("doc_id", "keep_id", "group_size", "kept").collect()]
            for rows in ([(5, "a b")], [(1, "a  b"), (2, "a b"), (7, "new")], [(3, "a\tb"), (8, "new")])]
    assert [sorted(x) for x in told] == [[(5, 5, 1, True)], [(1, 5, 3, False), (2, 5, 3, False), (7, 7, 1, True)], [(3, 5, 4, False), (8, 7, 2, False)]]
    assert sorted((r["keep_id"], r["group_size"]) for r in index.read().collect()) == [(5, 4), (7, 2)]


def told(frame):
    return sorted(tuple(r) for r in frame.select("doc_id", "keep_id", "group_size", "kept").collect())


def test_index_replays_a_batch(spark):
    """A batch that comes again gets its first answer, wherever the earlier try was lost."""
    index = exact_dedup.fresh_index(spark, 2)
    one, two = (frame(spark, [(i, t, "en", "s", 3) for i, t in rows]) for rows in ([(5, "a b"), (6, "c")], [(1, "a  b"), (2, "new"), (3, "new")]))
    first = told(index.ingest(one, "one"))
    assert first == told(index.ingest(one, "one")) == [(5, 5, 1, True), (6, 6, 1, True)]
    # lost between the decisions and the index: the additions are made up for
    second = told(index.ingest(two, "two"))
    rows = sorted(tuple(r) for r in index.read().collect())
    spark.table(index.table).filter("batch = 'one'").write.mode("overwrite").parquet(index.path + "-saved")
    saved = spark.read.parquet(index.path + "-saved")
    index.drop()
    from lumenread.llm import common
    common.delete(spark, index.path)
    saved.write.format("parquet").option("path", index.path).bucketBy(2, "text_sha256").sortBy("text_sha256").saveAsTable(index.table)
    assert not index.has("two")
    assert told(index.ingest(two, "two")) == second == [(1, 5, 2, False), (2, 2, 2, True), (3, 2, 2, False)]
    assert sorted(tuple(r) for r in index.read().collect()) == rows
    # lost before the decisions were whole
    common.delete(spark, index.staged("two", "decided") + "/_SUCCESS")
    assert told(index.ingest(two, "two")) == second and sorted(tuple(r) for r in index.read().collect()) == rows
    index.drop()
    assert not index.exists()


@pytest.mark.parametrize("rows", [cases(), repeated(), []], ids=["cases", "repeated", "empty"])
def test_exact_decisions_in_batches(spark, rows):
    """Several batches through the anti-join decide as one would."""
    before = len(spark.catalog.listTables())
    found = exact_dedup.decisions(clashing(spark, rows))
    assert sorted([tuple(r) for r in found.collect()], key=str) == exact_brute(rows)
    assert len(spark.catalog.listTables()) == before


def test_exact_hot_digest_that_is_known(spark):
    index = exact_dedup.fresh_index(spark, 2)
    index.ingest(frame(spark, [(1, "hot", "en", "s", 3)]), "a")
    rows = [(i, "hot" if i % 2 else f"t{i}", "en", "s", 3) for i in range(10, 1010)]
    assert told(index.ingest(frame(spark, rows), "b")) == sorted((i, 1, 501, False) if i % 2 else (i, i, 1, True) for i, *_ in rows)


def test_exact_stage(spark):
    for rows in (cases(), repeated()):
        docs = clashing(spark, rows)
        kept = exact_dedup.drop_copies(docs)
        assert kept.columns == docs.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(x[0] for x in exact_brute(rows) if x[3])


def shingles(text):
    words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def near_brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    parts = defaultdict(list)
    for i in range(len(rows)):
        parts[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in parts.items()}
    return sorted([(r[0], len(s), least[find(i)] if least[find(i)] is not None else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))], key=str)


def chains():
    """Chains of edits, whose ends are linked only through the texts between them, and unlinked families."""
    rows = []
    for family in range(6):
        words = prose(100 + family, 160).split(" ")
        for step in range(12):
            words = list(words)
            for k in range(3):
                words[(step * 13 + k * 50 + 7) % 160] = f"w{family}x{step}y{k}"
            rows.append((len(rows), " ".join(words), "en", "s", 1))
    return rows


@pytest.mark.parametrize("rows", [cases(), repeated(), [], chains()], ids=["cases", "repeated", "empty", "chains"])
def test_near(spark, rows):
    found = minhash_dedup.linked(__import__("lumenread.llm.common", fromlist=["x"]).keyed_texts(clashing(spark, rows)))
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()], key=str) == near_brute(rows)


@pytest.mark.parametrize("crowd", [1, 3])
def test_near_with_crowded_keys(spark, monkeypatch, crowd):
    """First halves that many share are dealt out by both halves; no link is lost by that."""
    from lumenread.llm import common

    monkeypatch.setattr(minhash_dedup, "CROWD", crowd)
    rows = [*chains(), *((1000 + i, t, "en", "s", 1) for i, (_, t, *_) in enumerate(repeated()))]
    dealt, plain = [], minhash_dedup.halved
    monkeypatch.setattr(minhash_dedup, "halved", lambda rows, crowded: dealt.append(crowded is not None) or plain(rows, crowded))
    found = minhash_dedup.linked(common.keyed_texts(frame(spark, rows)))
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()], key=str) == near_brute(rows) and all(dealt)


def test_unlike_texts_on_one_half_key(spark):
    """Fifty thousand unlike nodes that share a first half: compared by both halves they are few pairs, found soon."""
    import time

    from functools import partial
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    sig = rng.integers(0, 256, (50_000, minhash_dedup.HASHES), dtype=np.uint8)
    sig[1] = sig[0]
    rows = [(i, 100, [7, *rng.integers(1 << 40, 1 << 60, minhash_dedup.BANDS - 1).tolist()], bytearray(s.tobytes())) for i, s in enumerate(sig)]
    nodes = spark.createDataFrame(rows, "node long, n_shingles long, keys array<long>, sig binary")
    crowded = minhash_dedup.crowded_keys(nodes)
    assert [r["key"] for r in crowded.collect()] == [7]
    began = time.time()
    keyed = minhash_dedup.halved(nodes.select(F.posexplode("keys").alias("band", "key"), "node", "n_shingles", "sig"), crowded).repartition(8, "key")
    found = {tuple(sorted(r)) for r in keyed.mapInArrow(partial(minhash_dedup.pair_up, minhash_dedup.led_pairs), "lead long, node long").collect()}
    assert (0, 1) in found and len(found) < 100 and time.time() - began < 60


def test_near_recall_on_graded_copies(spark):
    """Copies of all degrees of likeness around the threshold: at least 0.9 of the links that brute force finds, by components."""
    from lumenread.llm import common

    rows = []
    for family in range(60):
        words = prose(3000 + family, 200).split(" ")
        rows.append((len(rows), " ".join(words), "en", "s", 1))
        for k in range(1, 7):
            changed = [f"x{family}y{k}z{j}" if j % 200 in range(10, 200, max(7, 60 // k)) else w for j, w in enumerate(words)]
            rows.append((len(rows), " ".join(changed), "en", "s", 1))
    found = {r["doc_id"]: r["component_id"] for r in minhash_dedup.linked(common.keyed_texts(frame(spark, rows))).collect()}
    want = {i: c for i, _, c in near_brute(rows)}
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 50 and sum(found[i] == want[i] for i in linked) >= 0.9 * len(linked) and all(found[i] == i for i in want if i not in linked and want[i] == i and i not in want.values())


def test_near_very_long_text(spark):
    from lumenread.llm import common

    words = prose(4000, 60_000).split(" ")
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join([*words[:30_000], "changed", *words[30_001:]]), "en", "s", 1), (3, " ".join(words[:30_000]), "en", "s", 1), (4, "a " * 200_000, "en", "s", 1)]
    found = minhash_dedup.linked(common.keyed_texts(frame(spark, rows)))
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()], key=str) == near_brute(rows)


def test_near_stage(spark):
    docs = clashing(spark)
    kept = minhash_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c in near_brute(cases()) if i == c)


def test_shingle_sets_in_any_grouping():
    texts = [(t or "").encode() for _, t, *_ in cases()]
    together = minhash_dedup.shingle_sets(texts)
    assert all(np.array_equal(a, minhash_dedup.shingle_sets([t])[0]) for a, t in zip(together, texts, strict=True))
    assert [len(x) for x in together] == [len(shingles(t.decode())) for t in texts]


def cut_brute(rows):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(x[i:i + 200] for x in texts for i in range(len(x) - 199))
    out = []
    for (i, *_), x in zip(rows, texts, strict=True):
        cover = bytearray(len(x))
        for q in range(len(x) - 199):
            if seen[x[q:q + 200]] > 1:
                cover[q:q + 200] = b"\1" * 200
        rest = bytes(c for c, m in zip(x, cover, strict=True) if not m)
        runs = sum(1 for q in range(len(x)) if cover[q] and (q == 0 or not cover[q - 1]))
        out.append((i, len(x), len(x) - len(rest), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [cases(), repeated(), []], ids=["cases", "repeated", "empty"])
def test_suffixes(spark, rows):
    assert sorted([tuple(r) for r in suffix_dedup.digests(clashing(spark, rows)).collect()], key=str) == cut_brute(rows)


def test_suffixes_with_hot_keys(spark, monkeypatch):
    """Leading bytes with many contexts are dealt out by window; some rows repeat as a whole as well."""
    passage = prose(50, 70)
    rows = [(i, prose(200 + i, 30 + i) + " " + passage + " " + prose(300 + i, 20), "en", "s", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s", 1) for i in range(5)]
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    dealt, plain = [], suffix_dedup.dealt_by_window
    monkeypatch.setattr(suffix_dedup, "dealt_by_window", lambda hot: dealt.append(hot.count()) or plain(hot))
    assert sorted([tuple(r) for r in suffix_dedup.digests(frame(spark, rows)).collect()], key=str) == cut_brute(rows)
    assert dealt[0] > 3


@pytest.mark.parametrize("size", [1, 3, 1 << 30])
def test_suffixes_in_any_hashing_groups(spark, monkeypatch, size):
    """Contexts that a hashing group has several of, one of or none: however texts are grouped, the result is the same."""
    import pyarrow as pa

    passage = prose(53, 60)
    rows = [(i, prose(600 + i % 7, 10 + i % 7) + " " + passage + " " + prose(700 + i % 5, 20), "en", "s", 1) for i in range(30)] + [(50 + i, prose(800 + i, 50), "en", "s", 1) for i in range(5)]
    spans, asked = defaultdict(list), defaultdict(list)
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "tag": pa.array([b""] * len(rows)), "text": [r[1] for r in rows]})
    sampled = pa.Table.from_batches([x for a in range(0, len(rows), size) for x in suffix_dedup.sample_suffixes(iter([batch.slice(a, size)]))])
    keys = np.array(sampled["key"]).view(np.uint64) % 3
    found = [x for k in range(3) for part in suffix_dedup.settle(iter(sampled.filter(pa.array(keys == k)).combine_chunks().to_batches())) for x in part.to_pylist()]
    for x in found:
        (spans if x["kind"] == suffix_dedup.KIND_KNOWN else asked)[x["doc_id"]].append(x)
    texts = dict((r[0], r[1]) for r in rows)
    ask = pa.RecordBatch.from_pydict({"doc_id": list(asked), "tag": pa.array([b""] * len(asked)), "text": [texts[i] for i in asked], "asked": list(asked.values())})
    contexts = pa.Table.from_batches(list(suffix_dedup.cut_contexts(iter([ask]))))
    contexts = contexts.take(pa.array(sorted(range(len(contexts)), key=contexts["right"].to_pylist().__getitem__)))
    for part in suffix_dedup.compare_bucket(iter(contexts.combine_chunks().to_batches())):
        for x in part.to_pylist():
            spans[x["doc_id"]].append(x)
    want = {r[0]: r[2] for r in cut_brute(rows)}
    assert {i: len(t.encode()) - len(suffix_dedup.keep_rest(t.encode(), spans.get(i))[0]) for i, t in texts.items()} == want


def test_suffixes_of_rows_without_ids(spark):
    """Rows without an id whose texts share a 32-bit hash lose only what each itself repeats."""
    from pyspark.sql import functions as F

    passage, head = prose(54, 60), prose(55, 50)
    many = spark.range(150_000).select(F.concat(F.lit(head + " "), F.col("id").cast("string"), F.lit(" end")).alias("text"))
    one, two = [r["text"] for r in many.withColumn("h", F.hash("text")).withColumn("n", F.count("text").over(__import__("pyspark").sql.Window.partitionBy("h"))).filter("n > 1").orderBy("h", "text").limit(2).collect()]
    rows = [(None, one, None, None, None), (None, two, None, None, None), (None, prose(56, 30) + " " + passage, None, None, None), (3, passage, None, None, None), (None, prose(57, 80), None, None, None)]
    assert sorted([tuple(r) for r in suffix_dedup.digests(frame(spark, rows)).collect()], key=str) == cut_brute(rows)


def cut_here(rows):
    """cut_brute's rows by the operator's functions, in this process."""
    import pyarrow as pa

    texts = [(t or "").encode() for _, t, *_ in rows]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows]), "tag": pa.array([b""] * len(rows)), "text": pa.array([r[1] or "" for r in rows])})
    found = pa.Table.from_batches(list(suffix_dedup.settle(suffix_dedup.sample_suffixes(iter([batch]))))).to_pylist()
    spans, asked = defaultdict(list), defaultdict(list)
    for x in found:
        (spans if x["kind"] == suffix_dedup.KIND_KNOWN else asked)[x["doc_id"]].append(x)
    ask = pa.RecordBatch.from_pydict({"doc_id": list(asked), "tag": pa.array([b""] * len(asked)), "text": [texts[i].decode() for i in asked], "asked": list(asked.values())})
    if asked:
        contexts = pa.Table.from_batches(list(suffix_dedup.cut_contexts(iter([ask]))))
        contexts = contexts.take(pa.array(sorted(range(len(contexts)), key=contexts["right"].to_pylist().__getitem__)))
        for part in suffix_dedup.compare_bucket(iter(contexts.combine_chunks().to_batches())):
            for x in part.to_pylist():
                spans[x["doc_id"]].append(x)
    out = []
    for i, data in enumerate(texts):
        rest, runs = suffix_dedup.keep_rest(data, spans.get(i))
        out.append((i, len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [150, 300, 777, 1 << 20])
def test_suffixes_of_texts_in_segments(monkeypatch, segment):
    """Long texts are hashed in parts; where the cuts fall is nothing to the result."""
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    passage = prose(60, 90)
    rows = [(0, prose(61, 900)), (1, prose(62, 200) + " " + passage + " " + prose(63, 300)), (2, passage + prose(64, 40)), (3, "ab" * 600), (4, prose(65, 3)), *((i, prose(100 + i, 40 * i)) for i in range(5, 12))]
    assert cut_here(rows) == cut_brute(rows)
    assert cut_here(cases()) == cut_brute(cases())


def test_hot_windows_agree(spark):
    passage = prose(51, 70)
    texts = [prose(400 + i, 9) + " " + passage + " " + prose(500 + i, 9) for i in range(6)]
    rows = []
    for i, t in enumerate(texts):
        data, at = t.encode(), t.index(passage) + 40
        first, last = max(0, at - suffix_dedup.REACH), at
        rows.append((False, i, bytearray(), at, first, last, bytearray(data[at: at + 200]), bytearray(data[max(0, at - suffix_dedup.REACH): at])))
    found = suffix_dedup.dealt_by_window(spark.createDataFrame(rows, suffix_dedup.CONTEXTS)).collect()
    plain = suffix_dedup.repeated_windows([bytes(r[6]) for r in rows], [bytes(r[7]) for r in rows], np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), np.array([r[5] for r in rows]))
    assert sorted((r["doc_id"], r["first"]) for r in found) == sorted(plain)


def test_suffix_stage(spark):
    docs = clashing(spark)
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    found = {r["doc_id"]: r["text"] for r in out.collect()}
    want = {i: (n - m) for i, n, m, _, _ in cut_brute(cases())}
    assert found[8] is None and all(len((found[i] or "").encode()) in (n, n - 1, n - 2, n - 3) for i, n in want.items() if i != 15)


def test_multikey_sort():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 3, (500, 20)).astype(np.uint8)
    order, shared = suffix_dedup.multikey_sort(rows)
    plain = [rows[i].tobytes() for i in order]
    assert plain == sorted(r.tobytes() for r in rows)
    assert all(shared[k] == next((j for j in range(20) if plain[k][j] != plain[k - 1][j]), 20) for k in range(1, 500))
