"""What the review of round 4 found."""

import math
import random
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import numpy as np

from lumenread import operators
from lumenread.operators import leftcorner, parts, tagger, trees

PAGES = ["<p>One two, three. Four five, six.</p><h1>A b</h1>", "<p>One, two; three: four!</p><p>p , p. p, q.</p>", "<script>x</script>bare words. <li>one</li>"] * 3


def folder(spark, tmp_path, pages):
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_costs_are_told_without_a_join_of_trees(spark, tmp_path):
    at = folder(spark, tmp_path, PAGES)
    names = [*tagger.KEY, "wnum", "surprisal", "unseen"]
    made = leftcorner.left_corner_surprisal(spark, at)
    # nothing but counts of decisions is dealt out, neither sentences nor a row for each decision of a tree
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    want = rows(made, *names)
    for head in (0, 3, 20):  # decisions that tasks don't know are joined
        assert rows(leftcorner.left_corner_surprisal(spark, at, head), *names) == want
    shapes = {r["shape"]: r["text"] for r in leftcorner.page_shapes(spark, at).join(tagger.page_trees(spark, at, words=False), list(tagger.KEY)).collect()}
    assert all(leftcorner.shape_tree(shape) == trees.parse(text) for shape, text in shapes.items())
    empty = folder(spark, tmp_path / "none", [])
    assert rows(leftcorner.left_corner_surprisal(spark, empty), *names) == []


def test_a_task_hands_over_what_it_holds(monkeypatch):
    import pyarrow as pa

    shapes = [f"p {'_' * n}{mark}" for n in (1, 4, 900) for mark in ".,_"] * 4
    batches = lambda: (pa.RecordBatch.from_pydict({"n": [k], "shape": [s]}) for k, s in enumerate(shapes))
    def told():
        counts = {}
        for b in leftcorner.count_decisions(batches()):
            for r in b.to_pylist():
                counts[r["pred"], r["resp"]] = counts.get((r["pred"], r["resp"]), 0) + r["n"]
        known = dict.fromkeys(list(counts)[::2], 1.0)
        costs = [list(leftcorner.tell_costs(known, whole, ["n"])(batches())) for whole in (True, False)]
        return counts, [[r for b in made for r in b.to_pylist()] for made in costs]

    want = told()
    monkeypatch.setattr(leftcorner, "HELD", 10)
    monkeypatch.setattr(leftcorner, "ROWS", 10)
    assert told() == want and sum(n for (pred, _), n in want[0].items() if pred[0] == "P") == sum(len(s) - 2 for s in shapes)
    # a long sentence's decisions are few different ones, and no row holds its tree
    assert len(want[0]) < 40


def test_parts_of_shapes_have_the_decisions_of_the_whole():
    rng = random.Random(4)
    for _ in range(3000):
        shape = rng.choice(["p ", "C ", ", ", "/h1 "]) + "".join(rng.choice("____.,;:!?") for _ in range(rng.randint(1, rng.choice([3, 12]))))
        told = [word for part, lo, hi in leftcorner.shape_parts(shape) for word in list(leftcorner.shape_words(part))[lo:hi]]
        assert told == list(leftcorner.shape_words(shape)) and len(told) == len(shape.split(" ")[1])


def test_sentences_of_any_length_cost(spark, tmp_path):
    long = [f"<p>{'a ' * n}b, {'c ' * n}d.</p><p>e</p>" for n in (10, 24, 25, 1500)]
    at = folder(spark, tmp_path, long)
    found = rows(leftcorner.left_corner_surprisal(spark, at), *tagger.KEY, "wnum", "surprisal", "unseen")
    assert len(found) == sum(2 * n + 5 for n in (10, 24, 25, 1500))
    steps = leftcorner.decision_table(tagger.page_trees(spark, at), *tagger.KEY)
    plain = leftcorner.surprisal(steps, leftcorner.conditional(steps.filter(tagger.TRAIN)), *tagger.KEY)
    assert rows(plain, *tagger.KEY, "wnum", "surprisal", "unseen") == found
    import duckdb

    con = duckdb.connect()
    con.execute(f"create table pages as select * from '{at}/pages.parquet/*.parquet'")
    want = con.execute(leftcorner.ORACLE["left_corner_surprisal"]).fetchall()
    assert [r[:4] for r in sorted(want)] == [r[:4] for r in found]
    assert all(abs(a[4] - b[4]) < 2e-5 and a[5] == b[5] for a, b in zip(sorted(want), found, strict=True))


def test_counts_come_back_to_parts_of_texts(spark):
    rng = random.Random(7)
    texts = [(rng.choice([None, 1, 2, 3]), [rng.choice(["a", "b", "the", "\u0130s", "w%s" % "xyz"[k % 3] * (k % 40)]) for k in range(rng.choice([0, 1, 2, 7, 8, 9, 40, 300]))]) for _ in range(40)]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in texts] + [(9, None)], "doc_id int, text string")
    texts = [(i, [w for t in words for w in t.lower().replace("\u0307", " ").split()]) for i, words in texts]
    words, pairs = Counter(w for _, t in texts for w in t), Counter(p for _, t in texts for p in zip(t, t[1:]))
    v = len(words)
    cost = lambda n, m: float(Decimal(repr(math.log((n + 1) / (m + v)))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    end = round(math.log(1 / v), 6)
    want = [(i, k + 1, cost(pairs[t[k - 1], t[k]], words[t[k - 1]]) if k else end, cost(pairs[t[k], t[k + 1]], words[t[k + 1]]) if k + 1 < len(t) else end) for i, t in texts for k in range(len(t))]
    for part, piece in ((1, 1), (1, 8), (50, 3), (10**6, 10**6)):  # parts of one batch, texts cut into pieces, all in one
        made = operators.run("transition_probs", {"documents": frame}, part=part, piece=piece)
        assert made.dtypes == [("doc_id", "int"), ("pos", "bigint"), ("fwd", "double"), ("bwd", "double")]
        assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)
    # no row a token is dealt out: compressed keys of parts' different pairs go to buckets, and counts come back
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and plan.count("RepartitionByExpression") == 1


def test_numbers_are_packed_and_rounded():
    arrays = [np.array([], np.uint64), np.array([3, 7, 2**63, 2**64 - 1], np.uint64), np.arange(1000, dtype=np.uint32), np.array([0, 255], np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(parts.unpacked(parts.packed(*arrays)), arrays, strict=True))
    assert (np.cumsum(parts.steps(arrays[1]), dtype=np.uint64) == arrays[1]).all()
    values = [-5.1234565, -5.1234575, -0.0000005, -0.0000004, 0.0, -1e-9, -12.9999995, -3.25]
    want = [float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for x in values]
    assert parts.rounded(np.array(values)).tolist() == want and not np.signbit(parts.rounded(np.array([-1e-9])))[0]
    x = np.random.default_rng(1).integers(0, 50, 300)
    assert all((a == b).all() for a, b in zip(parts.numbered(x), np.unique(x, return_inverse=True), strict=True))
