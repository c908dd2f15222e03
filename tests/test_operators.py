"""Operators on small hand-made inputs."""

import json

import numpy as np
import pytest

from lumenread.operators import gaze, learn, trees
from lumenread.sources import readers, sinks


def test_worked_example_of_measures(spark):
    fixations = [(1, 3, 2, 221.0), (1, 4, 3, 169.0), (1, 5, 5, 171.0), (1, 6, 5, 144.0), (1, 7, 2, 190.0), (1, 8, 2, 116.0), (1, 9, 4, 162.0), (1, 10, 6, 149.0)]
    rows = gaze.reading_measures(spark.createDataFrame(fixations, "user_id long, i long, w int, d double")).collect()
    found = {r["wnum"]: (r["ffd"], r["fpd"], r["rpd"], r["td"]) for r in rows}
    assert found == {2: (221, 221, 221, 527), 3: (169,) * 4, 4: (162,) * 4, 5: (171, 315, 315, 315), 6: (149,) * 4}


def test_measures_of_nothing(spark):
    assert gaze.reading_measures(spark.createDataFrame([], "user_id long, i long, w int, d double")).count() == 0


def test_dispersion():
    t = np.arange(10) * 20.0
    x = np.array([1, 2, 1, 2, 1, 90, 91, 90, 91, 90.0])
    assert gaze.dispersion_fixations(t, x, np.zeros(10), 10, 50, 80) == [(0, 4), (5, 9)]
    assert gaze.dispersion_fixations(t[:0], x[:0], x[:0], 10, 50, 80) == []


def test_ridge_and_logistic_match_plain_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 2))
    y = x @ [2.0, -1.0] + 0.5 + rng.standard_normal(200) * 0.1
    z = (x[:, 0] + rng.standard_normal(200) > 0).astype(float)
    frame = spark.createDataFrame([(float(a), float(b), float(c), float(e)) for (a, b), c, e in zip(x, y, z, strict=True)], "a double, b double, y double, z double")
    intercept, weights = learn.ridge(learn.matrix(learn.moments(frame, ["a", "b"], "y").first()["moments"]), 3.0)
    c = x - x.mean(0)
    want = np.linalg.solve(c.T @ c + 3 * np.eye(2), c.T @ (y - y.mean()))
    assert np.allclose(weights, want) and np.isclose(intercept, y.mean() - x.mean(0) @ want)
    found = learn.logistic(frame, ["a", "b"], "z")
    full = np.c_[np.ones(200), x]
    p = 1 / (1 + np.exp(-full @ found))
    assert np.allclose(full.T @ (z - p) - np.r_[0, found[1:]], 0, atol=1e-6)


def test_group_folds_keep_groups(spark):
    frame = spark.range(40).selectExpr("id % 7 as g", "cast(id as double) as a", "cast(2 * id as double) as y")
    scores = learn.group_cv(frame, "g", ["a"], "y", [1e-9], 3)
    assert scores["n"].sum() == 40 and (scores["r2"] > 0.999).all()


def test_trees():
    text = "( (S (NP-SBJ (D the) (N cat)) (VP (V sat) (P on) (N it))) ) ((X (-NONE- *)))"
    parsed = [trees.parse(t) for t in trees.split_trees(text)]
    assert len(parsed) == 2 and ("S", "NP VP", False) in list(trees.productions(parsed[0]))
    assert trees.written(trees.binarised(trees.parse("(A (B b) (C c) (D d))"))) == "(A (B b) (A (C c) (D d)))"
    assert [w for _, w, _ in trees.leaves(parsed[0])] == ["the", "cat", "sat", "on", "it"]
    assert ("-NONE-", "*", True) in list(trees.productions(parsed[1]))
    assert trees.parse("((A a)") is None and list(trees.split_trees("")) == []


def test_head_depths():
    assert trees.head_depths([3, 3, 0, 6, 6, 3]) == [1, 1, 0, 2, 2, 1]
    assert trees.head_depths([2, 1]) == [1, 1] and trees.head_depths([9]) == [0]


def test_readers(spark, tmp_path):
    log = "head\n" + "\n".join("a b c d e f 2 221 x y 3".split(" ") and ["a b c d e f 2 221 x y 3", "a b c d e f 0 10 x y 4", "short line"])
    (tmp_path / "sb03ma2p.dat").write_text(log, encoding="latin-1")
    (tmp_path / "sa02ma2p.dat").write_text("head\na b c d e f 5 100 x y 1\n")
    (tmp_path / "sc01ma2p.dat").write_text("head\na b c d e f 5 oops x y 1\n")
    rows = readers.file_keys(readers.fixation_log(spark, f"{tmp_path}/*ma2p.dat")).collect()
    assert sorted((r["reader"], r["article"], r["wnum"], r["fdur"], r["fxno"]) for r in rows) == [(0, 2, 5, 100, 1), (1, 3, 2, 221, 3)]
    (tmp_path / "many.json").write_text(json.dumps({"id": 1, "a": "x"}, indent=1) + "\n" + json.dumps({"id": 2, "a": "ß"}, indent=1))
    assert [tuple(r) for r in readers.concatenated_json(spark, f"{tmp_path}/many.json", "id int, a string").collect()] == [(1, "x"), (2, "ß")]
    (tmp_path / "a.conllu").write_text("# text\n1\ta\t_\tN\t_\t_\t2\n1-2\tab\t_\t_\t_\t_\t_\n2\tb\t_\tV\t_\t_\t0\n\n1\tc\t_\tN\t_\t_\t0\n")
    assert sorted((r["sentence"], r["id"], r["head"]) for r in readers.conllu(spark, f"{tmp_path}/a.conllu").collect()) == [(0, 1, 2), (0, 2, 0), (1, 1, 0)]


def test_norms_and_replies(spark):
    rows = spark.createDataFrame([("Cat", 5.53, None, 3.54), ("dog", None, None, None), ("cat", 4.0, None, None)], "w string, a double, b double, c double")
    found = {r["word"]: (r["aoa_mean"], round(r["aoa_std"], 3)) for r in readers.acquisition_norms(rows.limit(2), "a", "b", ["a", "b", "c"], "w").collect()}
    assert found == {"cat": (5.53, 0.995)}
    told = readers.replies(spark.createDataFrame([("S01 | one",), ("* S02 | two ",), ("S01 | again",), ("noise",)], "text string").coalesce(1)).collect()
    assert {r["id"]: r["reply"] for r in told} == {"S01": "again", "S02": "two"}


def test_survey_and_sinks(spark):
    wide = spark.createDataFrame([("r1", "A", "3")], ["rater", "1. Easier", "1. Difficulty A"])
    assert sorted(tuple(r) for r in readers.survey(wide, ["rater"]).collect()) == [("r1", 1, "Difficulty A", "3"), ("r1", 1, "Easier", "A")]
    words = spark.createDataFrame([(1, "the"), (2, "cat")], "wnum int, word string")
    fixations = spark.createDataFrame([(2, 200, 1)], "wnum int, fdur int, fxno int")
    assert [r["line"] for r in sinks.word_ordered_lines(words, fixations).collect()] == ["the 1 0 -99", "cat 2 200 1"]


def test_repair(spark):
    from lumenread.functions import repair

    assert repair.merged(["un", "known", "word"], {"unknown", "word"}) == ["unknown", "word"]
    assert repair.merged(["a", "b"], {"a", "b", "ab"}) == ["a", "b"] and repair.merged([], {"a"}) == []
    frame = spark.createDataFrame([("e\u0301e",), (None,)], "t string")
    assert [r[0] for r in frame.select(repair.nfc("t")).collect()] == ["\u00e9e", None]
    doubled = spark.createDataFrame([("kaa\u0bbe\u0bbe b \u0bbe",)], "t string")
    from pyspark.sql import functions as F

    assert doubled.select(repair.single_signs(F.col("t"), "\u0bbe")).first()[0] == "kaa\u0bbe b\u0bbe"


def test_providers(spark):
    from lumenread.functions import providers
    from pyspark.sql import functions as F

    tokens = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (1, 4, "b")], "doc_id long, pos long, word string")
    found = {r["pos"]: r["surprisal"] for r in providers.BigramSurprisal(tokens).surprisal(tokens).collect()}
    assert found[1] == 0 and np.isclose(found[2], -np.log(3 / 4)) and np.isclose(found[3], -np.log(2 / 4))
    golden = spark.range(1).select(providers.laplace_logp(F.lit(6), F.lit(464556), F.lit(335051.0)).alias("f"), providers.laplace_logp(F.lit(None), F.lit(77), F.lit(335051.0)).alias("b")).first()
    assert np.isclose(golden["f"], -11.64596548689194) and np.isclose(golden["b"], -12.72226782738182)
    words = spark.createDataFrame([("walking",), ("ing",)], "word string")
    assert [list(r[0]) for r in words.select(providers.SuffixSegments(["ing", "g"]).segments(F.col("word"))).collect()] == [["walk", "ing"], ["ing"]]
    assert providers.CorpusFrequency(tokens).log_frequency(words).filter("log_freq < -20").count() == 2


def test_more_readers(spark, tmp_path):
    frame = spark.createDataFrame([("a | b c|d",)], "regions string")
    assert list(readers.items(frame).first()["parts"]) == ["a", "b c", "d"]
    with pytest.raises(Exception, match="empty region"):
        readers.items(spark.createDataFrame([("a||d",)], "regions string")).collect()
    from pyspark.sql import functions as F

    script = spark.createDataFrame([('var items = [{"id": 1}, {"id": 2}];',)], "t string")
    assert [x["id"] for x in script.select(readers.script_items(F.col("t"), "array<struct<id:int>>").alias("x")).first()["x"]] == [1, 2]
