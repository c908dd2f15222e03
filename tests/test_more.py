"""Readers, sinks, trees, segmenter and operators on frames of one's own."""

import io
import itertools
import json
import math
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenread import operators
from lumenread.functions import providers, repair, segment
from lumenread.operators import gaze, learn, trees
from lumenread.sources import readers, sheets, sinks


def test_operators_on_own_columns(spark):
    rows = [(r, k, float((k * 7 + ord(r)) % 11), k % 5) for r in ("a", "b") for k in range(1, 30)]
    mine = spark.createDataFrame(rows, "reader string, nth long, rt double, len int")
    found = {r["reader"]: r["rho"] for r in operators.run("spearman", {"fix": mine}, {"user_id": "reader", "d": "rt", "w": "len"}).collect()}
    rank = lambda x: np.array([(np.array(x) < v).sum() + ((np.array(x) == v).sum() - 1) / 2 for v in x])
    for r in ("a", "b"):
        x, y = [v[2] for v in rows if v[0] == r], [v[3] for v in rows if v[0] == r]
        assert np.isclose(found[r], np.corrcoef(rank(x), rank(y))[0, 1], atol=1e-6)
    few = operators.run("cluster_bootstrap_diff", {"fix": mine}, {"user_id": "reader", "d": "rt", "w": "len"}, draws=50).first()
    assert few["draws"] <= 50
    assert operators.relations("spearman") == ["fix"] and "blink_gaps" in operators.names()
    with pytest.raises(ValueError, match="fix"):
        operators.run("spearman", {}, {})
    with pytest.raises(ValueError, match="no operator"):
        operators.run("nothing", {})


def test_next_forward(spark):
    rng = np.random.default_rng(1)
    rows = [(int(u), i, None if rng.random() < 0.1 else int(rng.integers(0, 5))) for u in (1, 2, 3) for i in range(40)]
    found = {(r["u"], r["i"]): r["next_forward"] for r in gaze.with_next_forward(spark.createDataFrame(rows, "u long, i long, w long"), ["u"], "i", "w").collect()}
    for u, i, w in rows:
        assert found[u, i] == (None if w is None else next((j for v, j, x in rows if v == u and j > i and x is not None and x > w), None))


def test_workbooks_and_archives(spark, tmp_path):
    frame = spark.createDataFrame([("a|b", 1, 2.5), ("<c>", None, -1.0)], "name string, n int, x double")
    sinks.write_workbook(str(tmp_path / "book.xlsx"), {"One": frame, "Two & more": frame.select("n")})
    found = sorted(tuple(r) for r in readers.workbook(spark, f"{tmp_path}/book.xlsx").collect())
    assert ("book.xlsx", "One", 2, 1, "a|b") in found and ("book.xlsx", "One", 3, 3, "-1.0") in found and ("book.xlsx", "Two & more", 1, 1, "n") in found
    assert not any(r[1] == "One" and r[2:4] == (3, 2) for r in found)
    assert [sheets.column_number(sheets.column_letters(n)) for n in (1, 26, 27, 702, 703)] == [1, 26, 27, 702, 703]
    with pytest.raises(ValueError, match="more than 1"):
        sinks.write_workbook(str(tmp_path / "small.xlsx"), {"One": frame}, 1)
    with zipfile.ZipFile(tmp_path / "s1.zip", "w") as z:
        z.writestr("x/session.json", json.dumps({"pid": "p1", "started": "2024-01-01", "completed": True}))
    with zipfile.ZipFile(tmp_path / "s2.zip", "w") as z:
        z.writestr("session.json", json.dumps({"pid": "p1", "started": "2024-02-01", "completed": True}))
    with zipfile.ZipFile(tmp_path / "s3.zip", "w") as z:
        z.writestr("session.json", json.dumps({"pid": "p1", "started": "2024-03-01", "completed": False}))
    assert [(r["archive"], r["started"]) for r in readers.sessions_of(spark, f"{tmp_path}/s*.zip").collect()] == [("s2.zip", "2024-02-01")]
    with tarfile.open(tmp_path / "trees.tar.bz2", "w:bz2") as t:
        data = b"( (S (N a) (V b)) )\n( (S (N c)) )"
        info = tarfile.TarInfo("wsj/1.mrg")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    assert [(r["file"], r["place"]) for r in trees.tree_files(spark, f"{tmp_path}/trees.tar.bz2").orderBy("place").collect()] == [("wsj/1.mrg", 0), ("wsj/1.mrg", 1)]


def test_folders_maps_and_parallel_files(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "A.xml").write_text('<s><w c5="X">Über </w><w>12</w><w>cats</w></s>')
    (tmp_path / "deep" / "B.txt").write_text("<w>no</w>")
    assert [(r["file"], r["place"], r["word"]) for r in readers.xml_words(spark, str(tmp_path / "deep")).collect()] == [("A.xml", 0, "über"), ("A.xml", 2, "cats")]
    (tmp_path / "map.txt").write_text("the\tDT\t1\t1\t1\ncat\tNN\t1\t2\t1\ncat\tVB\t1\t2\t1\nsat\t\t1\t3\t1\n")
    assert sorted(tuple(r) for r in readers.pos_map(spark, f"{tmp_path}/map.txt").collect()) == [(1, 1, "DT"), (1, 2, "NN"), (1, 3, "NN")]
    (tmp_path / "s.txt").write_text("one two\nthree\n")
    (tmp_path / "n.json").write_text("[[1, 2], [3]]")
    (tmp_path / "bad.json").write_text("[[1, 2]]")
    assert sorted((r["line"], r["sentence"], list(r["numbers"])) for r in readers.parallel_lines(spark, f"{tmp_path}/s.txt", f"{tmp_path}/n.json").collect()) == [(1, "one two", [1, 2]), (2, "three", [3])]
    with pytest.raises(Exception, match="different lengths"):
        readers.parallel_lines(spark, f"{tmp_path}/s.txt", f"{tmp_path}/bad.json").collect()
    (tmp_path / "bi.csv").write_text("w1,w2,n\nnull,nan,3\nNA,the,4\n")
    assert sorted(tuple(r) for r in readers.ngrams(spark, f"{tmp_path}/bi.csv").collect()) == [("NA", "the", 4), ("null", "nan", 3)]
    (tmp_path / "a.conllu").write_text("# sent_id = s1\n# text = a = b\n1\ta\t_\tN\t_\t_\t0\n\n1\tc\t_\tN\t_\t_\t0\n")
    assert [(r["sentence"], r["attributes"]) for r in readers.conllu_comments(spark, f"{tmp_path}/a.conllu").collect()] == [(0, {"sent_id": "s1", "text": "a = b"})]


def test_candidates(spark, tmp_path):
    rows = [("c1", 1, bytearray(b"<html>"), "Class 3"), ("c1", 2, bytearray(b"%PDF-1"), "class 4"), ("c1", 3, bytearray(b"%PDF-1"), "Class 3 book"), ("c2", 1, bytearray(b"%PDF"), "x")]
    frame = spark.createDataFrame(rows, "key string, nth int, content binary, front string").withColumn("want", F.lit("class 3"))
    assert [(r["key"], r["nth"]) for r in readers.first_valid(frame, "key", ["nth"], names="want").collect()] == [("c1", 3)]
    boom = lambda p: 1 / 0
    assert providers.first_reply("x", [boom, lambda p: " ", lambda p: f" {p}! "]) == "x!" and providers.first_reply("x", [boom]) is None


def test_corpus_lines(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\tx\tthe cat 12 sat\nshort\tline\n")
    assert [list(r["words"]) for r in readers.corpus_lines(spark, f"{tmp_path}/c.tsv").collect()] == [["the", "cat", "sat"]]


def test_norms_take_the_last_by_order(spark):
    rows = spark.createDataFrame([("cat", 4.0, 2), ("Cat", 5.5, 1), ("dog", None, 1)], "w string, a double, nth int")
    assert [tuple(r) for r in readers.acquisition_norms(rows, "a", None, ["a"], "w", ["nth"]).collect()] == [("cat", 4.0, 0.0)]
    lines = spark.createDataFrame([("S01 | late", 2), ("S01 | soon", 1)], "text string, nth int")
    assert readers.replies(lines, order=["nth"]).first()["reply"] == "late"


def test_sinks(spark, tmp_path):
    words = spark.createDataFrame([(1, "the", 0, 0), (2, "cat", 0, 4), (3, "sat", 1, 0)], "wnum int, word string, line_no int, start_col int")
    events = spark.createDataFrame([("r1", 1.0, 2, "cat", 200.0), ("r1", 2.0, None, None, 90.0), ("r1", 3.0, 1, "the", 150.0), ("r2", 1.0, 3, "sat", 99.0)], "reader string, t double, wnum int, word string, fdur double")
    sinks.write_session(str(tmp_path / "s"), words, events)
    one = [r[0] for r in spark.read.text(f"{tmp_path}/s/words/reader=r1").collect()]
    assert [x.split() for x in one] == [["the", "1", "150", "2"], ["cat", "2", "200", "1"], ["-99", "3", "0", "0"]]
    assert [x.split()[0] for x in (r[0] for r in spark.read.text(f"{tmp_path}/s/events/reader=r1").collect())] == ["cat", "-99", "the"]
    assert spark.read.text(f"{tmp_path}/s/layout").count() == 3
    # r1 kept, r2's second word is an outlier, r3 skipped it, r4's sentence isn't good
    seen = [("r1", 1, 1, 100.0, 1, True, 1), ("r1", 1, 2, 50.0, 2, True, 1), ("r2", 1, 1, 80.0, 1, True, 1), ("r2", 1, 2, 999.0, 3, True, 0), ("r3", 1, 1, 60.0, 1, True, 1), ("r3", 1, 2, 0.0, 0, True, 1), ("r4", 1, 1, 7.0, 1, False, 0), ("r4", 1, 2, 7.0, 1, False, 0)]
    log = spark.createDataFrame(seen, "reader string, sid int, wnum int, td double, n_fix int, good boolean, keep int").selectExpr("*", "td as ffd", "td as fpd", "td as rpd")
    read = spark.createDataFrame([("r1", 1, 900.0, True, 1), ("r2", 1, 1100.0, True, 0), ("r3", 1, 400.0, True, None), ("r4", 1, 10.0, False, 0)], "reader string, sid int, time double, good boolean, correct int")
    sinks.write_corpus(str(tmp_path / "c"), log, read, spark.createDataFrame([(1, "Hi, you.")], "sid int, sentence string"))
    means = {r["wnum"]: (r["n_good"], r["n_kept"], r["skip_rate"], r["td"]) for r in spark.read.parquet(f"{tmp_path}/c/word_means").collect()}
    assert means == {1: (3, 3, 0.0, 80.0), 2: (3, 1, 0.333, 50.0)}
    one = spark.read.parquet(f"{tmp_path}/c/sentence_means").first()
    assert (one["n_readers"], one["n_good"], one["time"], one["accuracy"], one["td"]) == (4, 3, 800.0, 0.333, 72.5)
    assert spark.read.parquet(f"{tmp_path}/c/sentences").first()["tokens"] == "Hi , you ." and spark.read.parquet(f"{tmp_path}/c/participants").filter("accuracy is null").first()["reader"] == "r3"
    assert spark.read.parquet(f"{tmp_path}/c/readers").count() == 8
    people = spark.createDataFrame([("p1",)], "pid string")
    rows = spark.createDataFrame([("p1", 1), ("test", 2)], "pid string, x int")
    sinks.write_results(str(tmp_path / "r"), rows, rows, people)
    assert spark.read.parquet(f"{tmp_path}/r/calibration").count() == 1 and spark.read.parquet(f"{tmp_path}/r/results").count() == 2
    report = sinks.markdown("Title", {"rows": rows}, 1)
    assert report.startswith("# Title") and "| p1 | 1 |" in report and "2 rows, the first 1 shown." in report
    form, key = sinks.answer_key(spark.range(500).withColumnRenamed("id", "item_id"), "7")
    assert sorted(r["place"] for r in key.collect()) == list(range(1, 501)) and set(form.columns) == {"item_id", "place"}


def test_decision_lines(spark):
    asked = trees.decision_lines(spark.createDataFrame([(1, "(S a)"), (2, "(S b)")], "id long, text string"), ["tr", "a-z", "A-Z"], spark.createDataFrame([(1, "known")], "id long, output string"))
    assert sorted(tuple(r) for r in asked.collect()) == [(1, "known"), (2, "(S B)")]
    assert trees.one_line(trees.parse("(S-TMP=2 (NP-SBJ (D the))\n (V go))")) == "(S (NP (D the)) (V go))"


def test_models_saved_and_folds(spark, tmp_path):
    learn.save_model(spark, str(tmp_path / "m"), "ridge", {"intercept": 1.0, "a": 2.0}, {"a": 4.0})
    kind, terms, scales = learn.load_model(spark, str(tmp_path / "m"))
    frame = spark.createDataFrame([(8.0,), (None,)], "a double")
    assert kind == "ridge" and [r[0] for r in frame.select(learn.linear_score(terms, scales)).collect()] == [5.0, 1.0]
    folds = learn.stratified_folds(spark.range(4000).selectExpr("id as k", "id % 4 = 0 as y"), "y", "k").groupBy("fold", "y").count().collect()
    assert len(folds) == 20 and all(abs(r["count"] - (100 if r["y"] else 300)) < 60 for r in folds)
    import zlib

    words = spark.createDataFrame([("abc",), ("é",), ("",)], "w string")
    assert [r[0] for r in words.select(learn.fnv1a(F.col("w"))).collect()] == [0x1A47E90B, 0x19E2BCA2 if False else fnv("é"), 0x811C9DC5]
    assert [r[0] for r in words.select(learn.crc_fold(F.col("w"), 100)).collect()] == [zlib.crc32(w.encode()) % 100 for w in ("abc", "é", "")]
    assert learn.stream("split", 3, 7) == spark.range(1).select(F.expr("conv(substr(md5('split|3|7'), 1, 8), 16, 10) / 4294967296.0")).first()[0]


def fnv(text):
    h = 2166136261
    for c in text.encode():
        h = ((h ^ c) * 16777619) % (1 << 32)
    return h


def test_scripts(spark):
    frame = spark.createDataFrame([("கா",), ("ாக",), ("abc",)], "t string")
    assert [tuple(r) for r in frame.select(repair.has_script(F.col("t"), 0x0B80, 0x0BFF), repair.bare_signs(F.col("t"))).collect()] == [(True, False), (True, True), (False, False)]
