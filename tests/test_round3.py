"""What the review of round 3 found."""

import math
from collections import Counter

import numpy as np

from lumenread import operators
from lumenread.functions import segment
from lumenread.operators import agreement, trees


def test_trees_deeper_than_calls():
    n = 3000
    flat = f"(S {' '.join(f'(T w{k})' for k in range(n))})"
    binary = trees.written(trees.binarised(trees.parse(flat)))
    assert binary == "(S " + " (S ".join(f"(T w{k})" for k in range(n - 1)) + f" (T w{n - 1})" + ")" * (n - 1)
    assert [r for _, r, lexical in trees.productions(trees.parse(binary)) if not lexical] == ["T S"] * (n - 2) + ["T T"]
    assert [(w, d) for _, w, d in trees.leaves(trees.parse(binary))][-2:] == [(f"w{n - 2}", n - 1), (f"w{n - 1}", n - 1)]
    assert trees.binarised(trees.parse(binary)) is not None
    assert trees.written(trees.binarised(trees.parse("(A (B b) (C) (D d) (E (F f)))"))) == "(A (B b) (A (C ) (A (D d) (E (F f)))))"


def test_readers_with_a_log_of_nothing(spark):
    rows = [(1, i, float(d)) for i, d in enumerate([3, 5, 0, 8])] + [(2, i, float(d)) for i, d in enumerate([3, 5, 8])] + [(3, 1, 0.0)]
    found = {r["user_id"]: (r["n"], r["trimmed"], r["mean_log"]) for r in operators.run("trim_3sd", {"fix": spark.createDataFrame(rows, "user_id long, i long, d double")}).collect()}
    assert found == {1: (4, 0, -math.inf), 2: (3, 0, round(sum(math.log(d) for d in (3, 5, 8)) / 3, 6)), 3: (1, 0, None)}


def test_readers_meet_by_sets_of_words(spark, monkeypatch):
    monkeypatch.setattr(agreement, "BLOCK", 5)
    rng = np.random.default_rng(5)
    words = ([0, 1, 2, 3, 4], [0, 1, 2, 3], [2, 3, 4], [0, 1], [1, 2, 4, 5, 6])
    rows = [(u, w, None if (u + w) % 11 == 0 else float(rng.integers(1, 5))) for u in range(24) for w in words[u % len(words)]] + [(None, 1, 1.0), (3, None, 2.0)]
    rows += [(30, w, 7.0) for w in range(5)]  # one whose ranks are all equal
    schema = "user_id long, w int, d double"
    made = operators.run("pairwise_agreement", {"fix": spark.createDataFrame(rows, schema)})
    found = {r["user_id"]: (r["pairs"], r["mean_r"], r["mean_overlap"]) for r in made.collect()}
    import duckdb

    con = duckdb.connect()
    con.execute("create table fix (user_id bigint, w int, d double)")
    con.executemany("insert into fix values (?, ?, ?)", rows)
    from lumenread.functions.dialect import DUCK
    from lumenread.plans import statistics

    want = con.execute(statistics.pairwise_agreement(DUCK).replace("{fix}", "fix")).fetchall()
    assert found.keys() == {r[0] for r in want} and len(want) > 10
    for user, pairs, mean, overlap in want:
        assert found[user][0] == pairs and np.isclose(found[user][2], overlap) and (found[user][1] is None) == (mean is None)
        assert mean is None or np.isclose(found[user][1], mean, atol=1.1e-6)
    # no more rows leave a step than readers times sets of words, whatever the number of pairs
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "user_id#" in plan and not any("<" in line and "Join" in line for line in plan.splitlines())


def test_hardest_level_without_a_task_a_language(spark):
    docs = spark.createDataFrame([(1, "en", 10), (2, "en", 5000), (3, None, 5000), (4, "en", 10**6)], "doc_id long, lang string, n_chars long")
    text = "one two three four five six seven eight nine ten {}"
    sent = spark.createDataFrame([(1, 1, text.format("a")), (2, 1, text.format("b")), (2, 2, text.format("c")), (3, 1, text.format("c"))], "doc_id long, sid long, sentence string")
    made = operators.run("eligible", {"sent": sent, "documents": docs})
    # a document without a sentence is no level; no language is a level's own
    assert sorted((r["doc_id"], r["sentence"][-3:], r["copies"]) for r in made.collect()) == [(2, " b.", 1), (2, " c.", 2)]
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_across_documents_are_added_up_once(spark):
    rows = [(1, "a", None, "b"), (1, "b", "a", "a"), (1, "a", "b", "b"), (1, "b", "a", None), (7, "c", None, None), (9000, "a", None, "b"), (9000, "b", "a", None)]
    made = operators.run("bigram_across", {"seq": spark.createDataFrame(rows, "doc_id long, word string, prev string, next string")})
    assert {(r["w1"], r["w2"]): r["n"] for r in made.collect()} == {("a", "b"): 3, ("b", "a"): 1, ("b", "c"): 1, ("c", "a"): 1}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # first and last words are looked for in the rows that have them, and there is one sum by pair
    assert "isnull(prev" in plan and sum("Aggregate [w1" in line or "Aggregate [prev" in line for line in plan.splitlines()) == 1


def test_prices_of_parts_are_not_sent_to_all(spark):
    counts = spark.createDataFrame([("walking", 3), ("walked", 2), ("talking", 4)], "word string, n long")
    model = segment.train(counts, 1)
    plan = model.split(counts)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2


def test_costs_of_words_in_one_exchange_by_word(spark):
    docs = [(1, "a a a a b a c"), (2, "B c d, e"), (2, "a b"), (None, "q"), (4, None), (5, "..."), (6, "c a b c a b")]
    texts = [(i, [w.strip(",.").lower() for w in t.split() if w.strip(",.")]) for i, t in docs if t]
    words, pairs = Counter(w for _, t in texts for w in t), Counter(p for _, t in texts for p in zip(t, t[1:]))
    v = len(words)
    want = [(i, k + 1, round(math.log((pairs[t[k - 1], t[k]] + 1) / (words[t[k - 1]] + v)) if k else math.log(1 / v), 6),
             round(math.log((pairs[t[k], t[k + 1]] + 1) / (words[t[k + 1]] + v)) if k + 1 < len(t) else math.log(1 / v), 6)) for i, t in texts for k in range(len(t))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for share in (1, 5, 12, 10**6):  # no word, some words, words and pairs, all are frequent
        found = [tuple(r) for r in operators.run("transition_probs", {"documents": frame}, share=share).collect()]
        assert sorted(found, key=str) == sorted(want, key=str)
    nothing = operators.run("transition_probs", {"documents": frame.filter("doc_id in (4, 5)")})
    assert nothing.collect() == []
    plan = operators.run("transition_probs", {"documents": frame})._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
