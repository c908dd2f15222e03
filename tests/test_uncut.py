"""Queries that once read a part only, against plain Python over everything."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lumenread import operators


def rank(x):
    x = np.array(x)
    return np.array([(x < v).sum() + ((x == v).sum() - 1) / 2 for v in x])


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice([3, 20, 60, 200, 900, 4000])) for i in range(60)]
    sents = [(i, k, " ".join("x" * rng.randint(1, 6) for _ in range(rng.randint(1, 6)))) for i, _ in docs for k in range(1, rng.randint(2, 9))]
    frames = {"documents": spark.createDataFrame(docs, "doc_id long, n_chars long"), "sent": spark.createDataFrame(sents, "doc_id long, sid long, sentence string")}
    grade = {i: math.floor(math.log(n + 1)) for i, n in docs}
    return frames, [(i, k, grade[i], s.count(" ") + 1, len(s)) for i, k, s in sents]


def test_all_sentences_are_matched(texts):
    frames, rows = texts
    want = defaultdict(list)
    hits = defaultdict(list)
    for a in rows:
        for b in rows:
            if b[2] > a[2] and a[3] == b[3]:
                want[a[2], b[2]].append(abs(a[4] - b[4]))
                hits[b[2] - a[2]].append(1.0 if b[4] > a[4] else 0.5 if b[4] == a[4] else 0.0)
    found = {(r["low"], r["high"]): (r["pairs"], r["mean_gap"]) for r in operators.run("length_matched", frames).collect()}
    assert found == {k: (len(v), round(sum(v) / len(v), 6)) for k, v in want.items()}
    found = {r["gap"]: (r["n"], r["accuracy"]) for r in operators.run("gap_accuracy", frames).collect()}
    assert found == {k: (len(v), round(sum(v) / len(v), 6)) for k, v in hits.items()}


def test_pairs_are_drawn_from_all_sentences_of_a_split(texts):
    frames, rows = texts
    known = {(i, k): (g, w, c) for i, k, g, w, c in rows}
    side = {i: "test" if zlib.crc32(f"{g}-{i}".encode()) % 100 < 20 else "train" for i, _, g, _, _ in rows}
    found = operators.run("graded_pairs", frames).collect()
    partners, harder = defaultdict(list), set()
    for r in found:
        a, b = (r["doc_a"], r["sid_a"]), (r["doc_b"], r["sid_b"])
        easy, hard = (a, b) if r["harder"] == "b" else (b, a)
        assert known[a][0] == r["grade_a"] and known[b][0] == r["grade_b"] and r["gap"] == known[hard][0] - known[easy][0] >= 2
        assert r["length_matched"] == (abs(known[a][1] - known[b][1]) <= 1)
        # no document is on both sides of the split
        assert side[a[0]] == side[b[0]] == r["split"]
        partners[easy].append(known[hard][0])
        harder.add(r["harder"])
    assert harder == {"a", "b"} and {r["split"] for r in found} == {"train", "test"}
    # one partner from each harder grade of its own split for every sentence, whatever its document and place
    grades = {s: sorted({r[2] for r in rows if side[r[0]] == s}) for s in ("train", "test")}
    assert all(sorted(partners[i, k]) == [h for h in grades[side[i]] if h >= g + 2] for i, k, g, _, _ in rows)
    assert {r["gap"] for r in operators.run("graded_pairs", frames, least_gap=4).collect()} == {r["gap"] for r in found if r["gap"] >= 4}


def test_every_two_readers(spark):
    rng = np.random.default_rng(2)
    rows = [(int(u), int(i), int(w), float(rng.integers(1, 30))) for u in (1, 2, 5, 40, 1000, 70_000) for i, w in enumerate(rng.choice(9, 6 + u % 7))]
    found = {r["user_id"]: (r["pairs"], r["mean_r"], r["mean_overlap"]) for r in operators.run("pairwise_agreement", {"fix": spark.createDataFrame(rows, "user_id long, i long, w int, d double")}).collect()}
    total = defaultdict(lambda: defaultdict(float))
    for u, _, w, d in rows:
        total[u][w] += d
    want = defaultdict(list)
    for a in total:
        for b in total:
            both = sorted(set(total[a]) & set(total[b]))
            if a < b and len(both) >= 3:
                x, y = rank([total[a][w] for w in both]), rank([total[b][w] for w in both])
                want[a].append((np.corrcoef(x, y)[0, 1] if x.std() and y.std() else None, len(both)))
    assert found.keys() == want.keys() and len(want) >= 4
    for u, v in want.items():
        r = [x for x, _ in v if x is not None]
        assert found[u][0] == len(v) and np.isclose(found[u][1], np.mean(r), atol=1e-6) and np.isclose(found[u][2], np.mean([n for _, n in v]), atol=1e-6)


def test_contexts_of_any_length(spark):
    rng = random.Random(3)
    rows = [(c, t, " ".join(["w"] * rng.choice([0, 0, 1, 5, 30, 70, 200]))) for c in range(6) for t in range(40)]
    found = {(r["conv_id"], r["turn"]): (r["context_turns"], r["context_words"]) for r in operators.run("context_budget", {"conversations": spark.createDataFrame(rows, "conv_id long, turn long, text string")}).collect()}
    for c in range(6):
        sizes = [len(t.split()) for k, _, t in rows if k == c]
        for t in range(40):
            used = n = 0
            while n < min(t, 5) and used + sizes[t - 1 - n] <= 120:
                used += sizes[t - 1 - n]
                n += 1
            assert found[c, t] == (n, used)


def test_quantiles_over_buckets(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(i), float(x)) for k in ("a", "b", "c") for i, x in enumerate(rng.choice([rng.normal(0, 50, 301), rng.integers(0, 4, 301)][k == "b"], 301 if k != "c" else 1))]
    found = {r["event_type"]: r for r in operators.run("percentile_ci", {"fix": spark.createDataFrame(rows, "event_type string, i long, d double")}).collect()}
    for k, r in found.items():
        x = [v for e, _, v in rows if e == k]
        assert r["n"] == len(x) and np.allclose([r["low"], r["median"], r["high"]], np.quantile(x, [0.025, 0.5, 0.975]), atol=1e-6)
        assert np.isclose(r["iqr"], np.subtract(*np.quantile(x, [0.75, 0.25])), atol=1e-6)
