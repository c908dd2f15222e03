import hashlib
import zlib

import numpy as np
import pytest
from helpers import cases, clashing, frame, prose, repeated
from lumenread.llm import common, edit_prints, kneser_ney, masked_lm, toxicity, words


def walked(text):
    """One text's walk, step by step."""
    coded, level, at, j, out = edit_prints.classes(text), edit_prints.level_of(len(text)), 0, 0, []
    while at < len(coded):
        if j % edit_prints.BLOCK == 0:
            go, rank = edit_prints.moves(j // edit_prints.BLOCK), edit_prints.priorities(j, edit_prints.BLOCK)
        if rank[j % edit_prints.BLOCK] >= level and len(out) < edit_prints.MOST:
            out.append("0123456789abcdef"[coded[at] % 16])
        at += go[j % edit_prints.BLOCK][coded[at]]
        j += 1
    return f"{level:02x}" + "".join(out)


def test_walks():
    texts = [t or "" for _, t, *_ in cases()]
    prints = edit_prints.fingerprints(texts)
    assert prints == [walked(t) for t in texts] and edit_prints.fingerprints([]) == []
    base = prose(9, 400)
    one = base[:500] + "z" + base[500:]
    near, far = (edit_prints.likeness(*edit_prints.fingerprints([base, x])) for x in (one, prose(10, 400)))
    assert near > 0.85 > 0.4 > far and edit_prints.likeness(prints[0], prints[1]) == 1


def test_walks_one_by_one(monkeypatch):
    """Texts that walk alone, from the start or after others have ended, have the fingerprints that they have side by side."""
    texts = [prose(70 + k, n) for k, n in enumerate((3, 40, 900, 2500))] + [""]
    monkeypatch.setattr(edit_prints, "FEW", 0)
    plain = edit_prints.fingerprints(texts)
    for few in (1, 2, 4, 100):
        monkeypatch.setattr(edit_prints, "FEW", few)
        assert edit_prints.fingerprints(texts) == plain == [walked(t) for t in texts]


def test_very_long_text_walks_soon():
    import time

    began = time.time()
    print_, = edit_prints.fingerprints([prose(90, 100) * 2000])
    assert time.time() - began < 20 and edit_prints.LEAST <= len(print_) - 2 <= edit_prints.MOST


def test_buckets_by_id_and_text():
    import pandas as pd

    cuts = sorted([(1, 5), (3, 0), (3, 7), (3, 9), (8, 2)])
    rows = [(a, h) for a in range(10) for h in range(12)]
    found = edit_prints.buckets_of(cuts).func(pd.Series([a for a, _ in rows]), pd.Series([h for _, h in rows])).tolist()
    assert found == [sum(c <= r for c in cuts) for r in rows]


ONE_ID = [(None if i % 3 else 7, prose(1000 + i, 3 + i % 9), None, None, None) for i in range(120)]


@pytest.mark.parametrize("rows", [cases(), cases()[:1], [], repeated(), ONE_ID], ids=["cases", "single", "empty", "repeated", "one id"])
def test_edit_print_rows(spark, rows):
    found = [tuple(r) for r in edit_prints.in_order(clashing(spark, rows)).mapInArrow(edit_prints.walk_rows, edit_prints.SCHEMA).collect()]
    order = sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t, *_ in rows), key=lambda x: x[:2])
    texts = [t for _, t, _ in order]
    changed = [edit_prints.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
    prints, others = edit_prints.fingerprints(texts), edit_prints.fingerprints(changed)
    want = [(i, len(t), hashlib.sha256(c.encode()).hexdigest(), p, o, edit_prints.likeness(p, o), edit_prints.likeness(p, n))
            for (_, t, i), c, p, o, n in zip(order, changed, prints, others, prints[1:] + prints[:1], strict=True)]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_near_prints(spark):
    base = prose(11, 300)
    rows = [(1, base, "en", "s", 1), (2, base, "en", "s", 1), (3, base[:700] + "q" + base[700:], "en", "s", 1), (4, prose(12, 300), "en", "s", 1)]
    found = {(r["doc_id"], r["lead_id"]) for r in edit_prints.near_copies(edit_prints.prints_of(frame(spark, rows))).collect()}
    assert {(2, 1), (3, 1)} <= found and not any(4 in x for x in found)


def test_near_prints_against_all_pairs(spark):
    """Changed openings, and near copies that share a header with a smaller id that isn't like them."""
    header, texts = prose(20, 40), []
    for k in range(8):
        body = prose(30 + k, 300)
        texts += [body, prose(60 + k, 30) + body[len(body) // 10:]]
    for k in range(6):
        body = header + " " + prose(80 + k, 260)
        texts += [body, body[:1000] + "q" + body[1000:]]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    prints = edit_prints.fingerprints(texts)
    want = {(i, j) for i in range(len(texts)) for j in range(i) if edit_prints.likeness(prints[i], prints[j]) >= 0.75}
    found = [(r["doc_id"], r["lead_id"]) for r in edit_prints.near_copies(edit_prints.prints_of(frame(spark, rows))).collect()]
    assert len(want) >= 9 and sorted(found) == sorted(want)


def test_bands_lengthen_with_the_texts():
    """Meetings by chance for each text stay few whatever the number of texts, and the bands' recall at the threshold stays."""
    chance = []
    for k in range(2, 12):
        notes, bands = edit_prints.bands_for(10**k)
        assert 1 - (1 - edit_prints.LIKE**notes) ** bands >= 1 - edit_prints.MISSED - 0.01
        chance.append(10**k * bands * edit_prints.RUNGS * edit_prints.BY_CHANCE**notes)
    assert max(chance) <= 1 and edit_prints.bands_for(0)[0] == edit_prints.BAND_NOTES
    # the sizes that were measured
    assert [edit_prints.bands_for(n) for n in (927, 9296, 50_000, 236_000)] == [(6, 13), (7, 18), (8, 23), (9, 31)]


def test_near_prints_of_none_without_ids_and_beside_other_columns(spark):
    assert edit_prints.near_copies(edit_prints.prints_of(frame(spark, []))).count() == 0
    rows = [(None, prose(3, 80), None, None, None), (None, prose(3, 80), None, None, None), (7, prose(3, 80), None, None, None), (8, prose(3, 80), None, None, None), (9, None, None, None, None), (10, "", None, None, None)]
    found = sorted((r["doc_id"], r["lead_id"]) for r in edit_prints.near_copies(edit_prints.prints_of(clashing(spark, rows))).collect())
    assert found == [(8, 7), (10, 9)]


def test_word_hashes_in_any_grouping():
    texts = [(t or "").encode() for _, t, *_ in cases()]
    together, upto = words.word_hashes(texts)
    split = np.split(together, upto[:-1])
    assert [len(x) for x in split] == [len(t.split()) for t in texts]
    assert all(np.array_equal(a, words.word_hashes([t])[0]) for a, t in zip(split, texts, strict=True))
    keys = np.unique(together)
    table = words.KeyTable(keys)
    assert np.array_equal(table.find(keys), np.arange(len(keys))) and (table.find(keys + np.uint64(1)) == -1).all()
    assert (words.KeyTable(keys[:0]).find(keys) == -1).all()


def plain_kneser_ney(texts):
    """Interpolated modified Kneser-Ney over words, by dictionaries."""
    from collections import Counter, defaultdict

    grams = {n: Counter(tuple(t[k:k + n]) for t in texts for k in range(len(t) - n + 1)) for n in (1, 2, 3)}
    counts = {3: grams[3]}
    for n in (2, 1):
        after = Counter(g[1:] for g in grams[n + 1])
        counts[n] = {g: after.get(g) or 1 for g in grams[n]}
    model = {}
    for n in (1, 2, 3):
        of = Counter(min(c, 5) for c in counts[n].values())
        n1, n2, n3, n4 = (max(1, of.get(k, 0)) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.05), k) for k, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        total, less = Counter(), defaultdict(float)
        for g, c in counts[n].items():
            total[g[:-1]] += c
            less[g[:-1]] += d[min(c, 3) - 1]
        model[n] = counts[n], d, total, {h: less[h] / total[h] for h in total}

    def p(g):
        n = len(g)
        c, d, total, weight = model[n]
        h = g[:-1]
        below = 1 / (len(c) + 1) if n == 1 else p(g[1:])
        if h not in total:
            return below
        return (max(0, c.get(g, 0) - d[min(c.get(g, 0), 3) - 1]) / total[h] if c.get(g) else 0) + weight[h] * below

    return lambda t: sum(np.log(p(tuple(t[max(0, k - 2):k + 1]))) for k in range(len(t)))


def test_kneser_ney_matches_dictionaries(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefgh"), 60, p=[.3, .2, .15, .1, .1, .05, .05, .05])) for _ in range(12)]
    plain = plain_kneser_ney([t.split() for t in texts])
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    new = ["a b c a zz b", "h", "", "q q q", texts[0]]
    for (n, score), text in zip(kneser_ney.Scorer(model).rows([t.encode() for t in new]), new, strict=True):
        assert n == len(text.split()) and (score is None if not n else np.isclose(score, plain(text.split()), rtol=1e-5))


def test_quality(spark):
    rows = repeated()
    nothing = spark.createDataFrame([], "doc_id long")
    assert all(r["kept"] for r in kneser_ney.classify(clashing(spark, rows), nothing).collect())
    some = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    found = kneser_ney.classify(clashing(spark, rows), some).collect()
    assert len(found) == len(rows) and all(r["kept"] and r["perplexity"] is None for r in found if r["n_words"] == 0)
    assert kneser_ney.classify(clashing(spark, []), some).count() == 0


def test_quality_decisions_by_hand(spark):
    """Means, quantiles, judged perplexities and decisions from scored rows, in plain Python; ties at the threshold stay."""
    rng = np.random.default_rng(6)
    rows = [(i, ["en", "fr", None, "rare"][i % 4 if i % 40 else 3], n := int(rng.integers(0, 200)), -float(n * rng.uniform(3, 9)) if n else None) for i in range(400)]
    rows = [(i, lang if lang != "rare" or i % 40 == 0 else "en", n, x) for i, lang, n, x in rows]
    scored = spark.createDataFrame([(i, lang, n, x, float(np.exp(-x / n)) if n else None) for i, lang, n, x in rows], "doc_id long, lang string, n_words long, log_prob double, perplexity double")
    trusted = [r for r in rows if r[0] % 2 == 0 and r[2]]
    found = {r["doc_id"]: r for r in kneser_ney.decide(scored, spark.createDataFrame([(r[0],) for r in rows if r[0] % 2 == 0], "doc_id long")).collect()}
    of = lambda lang: [r for r in trusted if r[1] == lang]
    mean = lambda own: sum(-r[3] for r in own) / sum(r[2] for r in own)
    usual = lambda lang: mean(of(lang) if len(of(lang)) >= kneser_ney.FEW else trusted)
    judge = lambda r: float(np.exp((-r[3] + kneser_ney.PRIOR * usual(r[1])) / (r[2] + kneser_ney.PRIOR)))
    def limit(lang):
        own = sorted(map(judge, of(lang) if len(of(lang)) >= kneser_ney.FEW else trusted))
        return own[int(np.ceil(kneser_ney.LEAVE * len(own))) - 1] * kneser_ney.SLACK

    assert len(found) == 400 and {len(of(x)) >= kneser_ney.FEW for x in ("en", "fr", "rare")} == {True, False}
    for r in rows:
        row = found[r[0]]
        assert np.isclose(row["threshold"], limit(r[1])) and (row["judged"] is None) == (r[2] == 0)
        assert row["kept"] == (r[2] == 0 or row["judged"] <= row["threshold"])
        assert r[2] == 0 or np.isclose(row["judged"], judge(r))


def test_quality_reads_long_trusted_texts(spark, monkeypatch):
    """Of a long trusted text some characters in a row are read, not always the first."""
    monkeypatch.setattr(kneser_ney, "LONGEST", 500)
    rows = [(i, prose(i, 400), "en", "s", 1) for i in range(60)]
    read, plain = [], kneser_ney.fit
    monkeypatch.setattr(kneser_ney, "fit", lambda trusted: read.extend(r["text"] for r in trusted.collect()) or plain(trusted))
    kneser_ney.classify(frame(spark, rows), spark.createDataFrame([(i,) for i in range(60)], "doc_id long")).count()
    assert len(read) > 30 and all(len(t) == 500 and any(t in r[1] for r in rows) for t in read) and sum(any(r[1].startswith(t) for r in rows) for t in read) < 5


def test_quality_counts_all_trusted_text(spark, monkeypatch):
    """Every trusted document that thresholds aren't taken from is counted, whole, whatever their number and length."""
    rows = [(i, prose(i % 7, 3) + f" w{i}", "en", "s", 1) for i in range(1500)] + [(1500, prose(3, 9000), "en", "s", 1)]
    read, plain = [], kneser_ney.fit
    monkeypatch.setattr(kneser_ney, "fit", lambda trusted: read.extend(r["text"] for r in trusted.collect()) or plain(trusted))
    kneser_ney.classify(frame(spark, rows), spark.createDataFrame([(r[0],) for r in rows], "doc_id long"))
    assert sorted(read) == sorted(r[1] for r in rows if zlib.crc32(str(r[0]).encode()) % 5)


def test_quality_joins_rare_grams(spark, monkeypatch):
    """Sums are the same whether tasks know all n-grams or most are joined; copies and repeated rows as well."""
    rows = [(i // 2, prose(i % 20, 5 + i % 30), "en", "s", 1) for i in range(80)] + [(90, None, "fr", "s", 0), (91, "", None, "s", 0), (92, "so new", None, "s", 0)]
    docs, ids = frame(spark, rows), spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    key = lambda r: (r["doc_id"], r["n_words"], r["log_prob"] or 0)
    whole = sorted(kneser_ney.classify(docs, ids).collect(), key=key)
    for head in (0, 60):
        monkeypatch.setattr(kneser_ney, "HEAD", head)
        found = sorted(kneser_ney.classify(docs, ids).collect(), key=key)
        assert len(found) == len(whole) == 83
        for a, b in zip(found, whole, strict=True):
            assert (a["doc_id"], a["lang"], a["n_words"], a["kept"]) == (b["doc_id"], b["lang"], b["n_words"], b["kept"])
            assert np.isclose(a["log_prob"] or 0, b["log_prob"] or 0, rtol=1e-9) and np.isclose(a["threshold"], b["threshold"], rtol=1e-9)


def test_quality_keeps_little_on_disk(spark, tmp_path, monkeypatch):
    """Tables of counts go when they aren't needed, rare n-grams are joined by shares of the keys, and keys are Spark's own of context and tail."""
    monkeypatch.setattr(kneser_ney, "HEAD", 0)
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = [(i, prose(i % 20, 5 + i % 30), "en", "s", 1) for i in range(60)]
    kneser_ney.classify(frame(spark, rows), spark.createDataFrame([(i,) for i in range(60)], "doc_id long"))
    left = {"-".join(p.name.split("-")[2:]) for p in tmp_path.iterdir()}
    assert left == {"trusted", "terms-1", "terms-2", "probabilities-3", "scored", *(f"told-{k}" for k in range(kneser_ney.ROUNDS))}
    a, b = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, (2, 50))
    both = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "context long, tail long").select("context", "tail", kneser_ney.key_of(2).alias("key")).collect()
    assert [r["key"] for r in both] == [int(kneser_ney.gram_keys(np.array([r["context"], r["tail"]]).view(np.uint64), 2).view(np.int64)[0]) for r in both]
    assert len(kneser_ney.gram_keys(np.zeros(1, np.uint64), 3)) == 0


def test_quality_parts_junk(spark):
    good = [(i, prose(1, 300)[i % 40:] + " " + prose(i, 4), "en", "s", 1) for i in range(200)]
    junk = [(1000 + i, " | ".join(prose(5000 + i, 60).split()), "en", "s", 1) for i in range(10)]
    found = {r["doc_id"]: r["kept"] for r in kneser_ney.classify(frame(spark, good + junk), spark.createDataFrame([(i,) for i in range(200)], "doc_id long")).collect()}
    assert sum(found[i] for i in range(200)) >= 196 and not any(found[1000 + i] for i in range(10))


def small_model(module, seed=1):
    return {k: v.astype(np.float64) for k, v in module.items()}


def check_gradients(model, grads, loss):
    for name, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = model[name][at]
        model[name][at] = old + 1e-4
        up = loss()
        model[name][at] = old - 1e-4
        down = loss()
        model[name][at] = old
        assert np.isclose((up - down) / 2e-4, g[at], rtol=1e-3, atol=1e-7), name


def test_masked_model():
    model = small_model(masked_lm.fresh())
    ids = np.array([3, 70, 4000, 3, 5, 200])
    around = masked_lm.neighbours(ids, np.array([4, 6]))
    assert around[:, 0].tolist() == [masked_lm.EDGE, masked_lm.EDGE, 70, 4000] and around[:, 4].tolist() == [masked_lm.EDGE, masked_lm.EDGE, 200, masked_lm.EDGE]
    grads = masked_lm.gradients(model, ids, around)
    slope, near = grads.pop("near"), np.zeros_like(model["near"])
    for k in range(len(masked_lm.PLACES)):
        np.add.at(near[k], around[k], slope)
    check_gradients(model, grads | {"near": near}, lambda: -masked_lm.log_probabilities(model, ids, around).mean())
    every = [masked_lm.log_probabilities(model, np.array([3, w, 5]), masked_lm.neighbours(np.array([3, w, 5]), np.array([3])))[1] for w in range(0, masked_lm.EDGE)]
    assert np.isclose(np.exp(every).sum(), 1)
    assert np.array_equal(masked_lm.packed(masked_lm.unpacked(masked_lm.packed(masked_lm.fresh()))), masked_lm.packed(masked_lm.fresh()))
    large = {k: v * 300 for k, v in model.items()}  # logits that have no exponential
    assert np.isfinite(masked_lm.log_probabilities(large, ids, around)).all() and all(np.isfinite(g).all() for g in masked_lm.gradients(large, ids, around).values())


def test_masked_scores(spark):
    rows = repeated()
    docs = common.keyed_texts(clashing(spark, rows))
    vocabulary = masked_lm.vocabulary_of(docs)
    values = masked_lm.packed(masked_lm.fresh())
    found = sorted([(r["doc_id"], r["n_words"], round(r["log_likelihood"], 3)) for r in masked_lm.score(docs, vocabulary, values).collect()], key=str)
    model, known, want = masked_lm.unpacked(values), masked_lm.Vocabulary(vocabulary), []
    for i, t, *_ in rows:
        ids = known.ids(words.word_hashes([(t or "").encode()])[0])
        total = 0.0
        for k in range(len(ids)):  # one word after the other
            near = [ids[k + p] if 0 <= k + p < len(ids) else masked_lm.EDGE for p in masked_lm.PLACES]
            total += float(masked_lm.log_probabilities(model, ids[k:k + 1], np.array(near)[:, None])[0])
        want.append((i, len(ids), total))
    assert all(a[:2] == (b[0], b[1]) and np.isclose(a[2], b[2], rtol=1e-4, atol=1e-2) for a, b in zip(found, sorted([(i, n, round(x, 3)) for i, n, x in want], key=str), strict=True))
    assert masked_lm.pseudo_likelihood(clashing(spark, [])).count() == 0


@pytest.mark.parametrize("told", [masked_lm.TOLD, 700, 0])
def test_masked_rare_words(spark, monkeypatch, told):
    """A rare word has its share of its bucket, so the probabilities of all words sum to 1; whether tasks are told or ask."""
    from collections import Counter

    monkeypatch.setattr(masked_lm, "TOLD", told)

    rows = [*repeated(), *((100 + i, prose(900 + i, 800), "en", "s", 1) for i in range(10))]
    docs = common.keyed_texts(clashing(spark, rows))
    counted = masked_lm.word_counts(docs)
    vocabulary, values = masked_lm.most_frequent(counted), masked_lm.packed(masked_lm.fresh())
    known, hashes = masked_lm.Vocabulary(vocabulary), [words.word_hashes([(t or "").encode()])[0] for _, t, *_ in rows]
    count = Counter(w for h in hashes for w in h.tolist())
    bucket = dict(zip(count, known.ids(np.array(list(count), np.uint64)).tolist(), strict=True))
    total = Counter()
    for w, n in count.items():
        total[bucket[w]] += n
    log_share = {w: np.log(n / total[bucket[w]]) if bucket[w] >= masked_lm.FREQUENT else 0.0 for w, n in count.items()}
    shares = {r["word"] % (1 << 64): r["log_share"] for r in masked_lm.rare_shares(counted, vocabulary).collect()}
    assert len(shares) > 1000 and shares.keys() == {w for w in count if bucket[w] >= masked_lm.FREQUENT}
    assert all(np.isclose(x, log_share[w]) for w, x in shares.items())
    key = lambda r: (str(r["doc_id"]), r["n_words"], r["log_likelihood"])
    plain = sorted(masked_lm.score(docs, vocabulary, values).collect(), key=key)
    extra = {(str(i), len(h)): sum(log_share[w] for w in h.tolist()) for (i, *_), h in zip(rows, hashes, strict=True)}
    found = sorted(masked_lm.score_words(docs, counted, vocabulary, values).collect(), key=key)
    assert [r["doc_id"] for r in found] == [r["doc_id"] for r in plain] and min(extra.values()) < -100
    assert all(np.isclose(a["log_likelihood"], b["log_likelihood"] + extra[str(a["doc_id"]), a["n_words"]], rtol=1e-5, atol=1e-2) for a, b in zip(found, plain, strict=True))


def test_masked_training_sees_every_document(spark, monkeypatch):
    """The words that all rounds' copies learned from are those of all documents."""
    docs = common.keyed_texts(frame(spark, [(i, f"w{i} red", "en", "s", 1) for i in range(300)]))
    vocabulary = masked_lm.vocabulary_of(docs)
    seen, plain = spark.sparkContext.accumulator(0), masked_lm.train_copies

    def watched(shared, vocabulary):
        run = plain(shared, vocabulary)

        def counting(batches):
            for batch in run(batches):
                seen.add(batch.column("words")[0].as_py())
                yield batch

        return counting

    monkeypatch.setattr(masked_lm, "train_copies", watched)
    masked_lm.train(docs, vocabulary)
    assert seen.value == 600


def test_masked_copies_are_averaged_in_two_levels(spark):
    rng = np.random.default_rng(0)
    rows = [(c, t, int(rng.integers(1, 50)), rng.standard_normal(5).astype("<f4").tobytes()) for t in range(200) for c in range(3)]
    found = {r["chunk"]: np.frombuffer(r["part"], "<f4") for r in masked_lm.averaged(spark.createDataFrame([(c, t, w, bytearray(p)) for c, t, w, p in rows], masked_lm.COPIES)).collect()}
    for c in range(3):
        parts, weights = np.array([np.frombuffer(p, "<f4") for k, _, _, p in rows if k == c]), np.array([w for k, _, w, _ in rows if k == c])
        assert np.allclose(found[c], (parts * weights[:, None]).sum(0) / weights.sum(), atol=1e-5)


def test_masked_end_to_end(spark):
    """Nulls, repeated rows and clashing names, from counting to scores; few documents are trained on as well."""
    rows = repeated()
    found = masked_lm.pseudo_likelihood(clashing(spark, rows)).collect()
    assert sorted(str((r["doc_id"], r["n_words"])) for r in found) == sorted(str((i, len((t or "").encode().split()))) for i, t, *_ in rows)
    assert all((r["mean_log_prob"] is None and r["log_likelihood"] == 0) if r["n_words"] == 0 else r["mean_log_prob"] < 0 for r in found)
    docs = common.keyed_texts(frame(spark, rows[:3]))
    vocabulary = masked_lm.vocabulary_of(docs)
    fresh = masked_lm.packed(masked_lm.fresh())
    assert not np.array_equal(masked_lm.train(docs, vocabulary), fresh)
    assert np.array_equal(masked_lm.train(docs.filter("text = ''"), vocabulary), fresh)


def test_masked_training_learns(spark):
    rows = [(i, " ".join(["red green blue yellow"] * 40), "en", "s", 1) for i in range(200)]
    docs = common.keyed_texts(frame(spark, rows))
    vocabulary = masked_lm.vocabulary_of(docs)
    mean = lambda values: masked_lm.score(docs.limit(1), vocabulary, values).first()["mean_log_prob"]
    docs = docs.selectExpr("doc_id", "concat(text, ' ', doc_id) as text")
    assert mean(masked_lm.train(docs, vocabulary)) > mean(masked_lm.packed(masked_lm.fresh())) + 1


def test_toxicity_gradients():
    model = small_model(toxicity.fresh_model())
    rng = np.random.default_rng(2)
    model |= {k: rng.standard_normal(toxicity.TOLD) for k in toxicity.COUNTED}
    vocabulary, flat, sizes = ["abc", "idiot", "x", "hello.", ""], np.array([0, 1, 2, 3, 4, 2, 3, 3, 1]), np.array([4, 2, 3])
    starts = np.cumsum(sizes) - sizes
    index, mask = toxicity.laid_out(flat, starts, starts + sizes)
    slope = np.array([1.0, -2, 0.5])
    gates, kept_in = toxicity.inputs(model, vocabulary)
    kept = {}
    toxicity.forward(model, gates, index, mask, kept)
    grads, d_gates = toxicity.backward(model, gates, index, kept, slope)
    check_gradients(model, grads | toxicity.input_gradients(model, kept_in, d_gates), lambda: (toxicity.forward(model, toxicity.inputs(model, vocabulary)[0], index, mask) * slope).sum())


def test_toxicity_forward_word_by_word():
    """The windows' logits by the gates' equations, one window and one word after the other."""
    model, rng = small_model(toxicity.fresh_model()), np.random.default_rng(4)
    model |= {k: rng.standard_normal(toxicity.TOLD) for k in toxicity.COUNTED}
    windows = [["abc", "idiot", "x"], ["hello."], ["x", "y", "x", "abc", "zz"]]
    words = sorted({w for x in windows for w in x})
    gates, _ = toxicity.inputs(model, words)
    flat = np.array([words.index(w) for x in windows for w in x])
    ends = np.cumsum([len(x) for x in windows])
    index, mask = toxicity.laid_out(flat, ends - [len(x) for x in windows], ends)
    found = toxicity.forward(model, gates, index, mask)
    h, sig = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))

    def gate(word):
        own, grams, _ = toxicity.features([word])
        told = model["told_gram"][grams % toxicity.TOLD]
        learned = np.concatenate([model["word"][own[0] % toxicity.WORDS], model["gram"][grams % toxicity.GRAMS].mean(0)])
        return np.concatenate([learned, [model["told_word"][own[0] % toxicity.TOLD], told.max(), told.mean()]]) @ model["inp"] + model["bias"]

    def passed(words, at, rec):
        state, out = np.zeros(h), []
        for w in words:
            g, u = gate(w)[at: at + 3 * h], state @ rec
            z, r = sig(g[:h] + u[:h]), sig(g[h:2 * h] + u[h:2 * h])
            state = z * state + (1 - z) * np.tanh(g[2 * h:] + r * u[2 * h:])
            out.append(state)
        return np.array(out)

    for own, logit in zip(windows, found, strict=True):
        both = np.concatenate([passed(own, 0, model["rec_f"]), passed(own[::-1], 3 * h, model["rec_b"])[::-1]], 1)
        weight = np.exp(np.tanh(both @ model["att"] + model["att_bias"]) @ model["att_out"])
        assert np.isclose((weight / weight.sum()) @ both @ model["out"] + model["out_bias"][0], logit, rtol=1e-6)


def test_toxicity_tells_by_other_folds():
    """Words that one document holds alone tell nothing of it; words that many toxic ones hold do."""
    samples = [(int(k < 20), f"common own{k} " + "slur" * (k < 20)) for k in range(60)]
    made = toxicity.Sample(samples)
    of = lambda told, w: told["told_word"][toxicity.features([w])[0][0] % toxicity.TOLD]
    for k in range(60):
        told = made.others[made.folds[k]]
        assert of(told, f"own{k}") == 0 and abs(of(told, "common")) < 0.1 and of(told, "slur") > 0.8
    assert of(made.model, "slur") >= of(made.others[0], "slur")
    # every document's deciding window is the one with its own largest logit
    model = toxicity.fresh_model() | made.model
    found = made.deciding_windows(model)
    assert len(found) == 60 and not found.any()
    long = toxicity.Sample([(k % 2, " ".join([f"w{i % 50}" for i in range(40 + 90 * k)] + ["slur"] * (k % 2))) for k in range(12)])
    for d, at in enumerate(long.deciding_windows(model)):
        words = [f"w{i % 50}" for i in range(40 + 90 * d)] + ["slur"] * (d % 2)
        scorer = toxicity.Scorer(model | long.others[long.folds[d]])
        starts = np.array(toxicity.window_starts(len(words)))
        logits = scorer.logits(words, starts, np.full(len(starts), len(words)))
        assert logits[starts.tolist().index(at)] >= logits.max() - 1e-5


def test_toxicity_tie_and_labels(spark):
    rows = [(1, "a", "en", "s", 1), (2, "b", "en", "s", 1)]
    model = toxicity.fresh_model() | {"out": np.zeros(2 * toxicity.HIDDEN, np.float32)}
    assert [(r["score"], r["predicted"]) for r in toxicity.score(frame(spark, rows), model).collect()] == [(0.5, 1)] * 2
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, None), (2, 0)], "doc_id long, toxic int")
    told = {i: t for i, t in ((1, 1), (2, 0)) if zlib.crc32(str(i).encode()) % 5}
    assert sorted(toxicity.sample(frame(spark, rows), labels)) == sorted((t, rows[i - 1][1]) for i, t in told.items())


def toxic_rows(n):
    rows = [(i, prose(i, 80 + i % 300), "en", "s", 1) for i in range(n)]
    return [(i, " ".join([*t.split()[:40], "scumbag", *t.split()[40:]]) if i % 4 == 0 else t, *r) for i, t, *r in rows]


def test_toxicity_held_out(spark):
    rows = toxic_rows(600)
    labels = spark.createDataFrame([(r[0], int(r[0] % 4 == 0)) for r in rows], "doc_id long, toxic int")
    docs = clashing(spark, rows)
    model = toxicity.train(toxicity.sample(docs, labels), steps=150)
    found = toxicity.score(docs, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    tested = [r for r in found if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in tested]) > 0.95
    # every window counts, and the score is that of the text alone
    scorer = toxicity.Scorer(model)
    long = prose(1, 5000) + " scumbag"
    again = scorer.scores([long, "", long])
    assert np.isclose(again[0], again[2], atol=1e-5) and again[0] > 0.9 and 0 <= again[1] <= 1
    assert np.allclose(toxicity.Scorer(model).scores([r[1] for r in rows[:20]]), [toxicity.Scorer(model).scores([r[1]])[0] for r in rows[:20]], atol=1e-5)


def test_toxicity_without_labels(spark):
    rows = repeated()
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.score(clashing(spark, rows), toxicity.train(toxicity.sample(clashing(spark, rows), labels))).collect()
    assert len(found) == len(rows) and all(r["score"] == 0 and r["predicted"] == 0 for r in found)
    assert toxicity.drop_toxic(clashing(spark, rows), labels).columns == clashing(spark).columns
    assert toxicity.score(clashing(spark, []), None).count() == 0


def test_windows_cover():
    for n in range(300):
        starts = toxicity.window_starts(n)
        assert starts[-1] + toxicity.WINDOW >= n and all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))
