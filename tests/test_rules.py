"""Orders, eligible sentences, repairs: single rules against plain Python or by hand."""

import math
import re

from pyspark.sql import functions as F

from lumenread import operators
from lumenread.functions import repair
from lumenread.operators import gaze, orders


def test_orders_are_shuffles_that_stay(spark):
    assert orders.code_hash("") == 2166136261 and orders.code_hash("a") == 0xE40C292C and orders.code_hash("foobar") == 0xBF9CF968
    stream = orders.numbers(1)
    drawn = [next(stream) for _ in range(20_000)]
    assert all(0 <= x < 1 for x in drawn) and abs(sum(drawn) / 20_000 - 0.5) < 0.01
    # the nth number depends on seed + n steps only
    later = orders.numbers(1 + 5 * orders.STEP & orders.WORD)
    assert drawn[5:10] == [next(later) for _ in range(5)]
    rows = [(p, i) for p in ("p1", "p2", "é", None) for i in (3, 1, 2, 2, None, 9, 4)]
    found = {}
    for r in orders.participant_orders(spark.createDataFrame(rows, "pid string, sid int"), "pid", "sid").collect():
        found.setdefault(r["pid"], {})[r["place"]] = r["sid"]
    for pid, own in found.items():
        assert [own[k] for k in range(1, 6)] == orders.dealt([1, 2, 3, 4, 9], orders.code_hash(pid or ""))
    assert found["p1"] != found["p2"] and len(found) == 4


def test_eligible_sentences(spark):
    good = "one two three four five six seven eight nine ten"
    sentences = [good, good, "few words", good + ". more", good + " 7", good + " (x)", good + ' "x"', "tion " + good, good + " tion", good + " ßa", good + " idiot", good + "?", good + " eleven"]
    sent = spark.createDataFrame([(1 if k else 5, k, s) for k, s in enumerate(sentences)] + [(2, 1, good + " easy")], "doc_id long, sid long, sentence string")
    docs = spark.createDataFrame([(1, "en", 900), (5, "en", 900), (2, "en", 50), (3, "fr", 9)], "doc_id long, lang string, n_chars long")
    found = {r["sentence"]: (r["doc_id"], r["copies"]) for r in operators.run("eligible", {"sent": sent, "documents": docs}).collect()}
    assert found == {good + ".": (1, 2), good + " eleven.": (1, 1), "tion " + good + ".": (1, 1)}


def test_only_script_words_are_joined():
    known = {"unknown", "a1b", "word"}
    assert repair.merged(["un", "known", "word"], known) == ["unknown", "word"]
    assert repair.merged(["a", "1", "b"], known) == ["a", "1", "b"]
    assert repair.merged(["un,", "known"], {"un,known"}) == ["un,", "known"]
    assert repair.merged(["ab", "c"], {"abc"}, script="[a-b]+") == ["ab", "c"]


def test_three_substitutions_in_order(spark):
    stop, sign = "்", "ா"
    rows = [f"க{stop}{stop}ததா", f"க{stop}{stop}தா", f"கா{sign}", "plain", None]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(repair.single_signs(F.col("t"), sign, stop, "கத")).collect()]
    assert found == [f"க{stop}தா", f"க{stop}தா", "கா", "plain", None]


def test_outliers_by_reader(spark):
    rows = [("r1", 1, w, float(d), float(d), float(d), float(d), 1, True) for w, d in enumerate([10] * 20 + [100])]
    rows += [("r1", 2, 0, 900.0, 900.0, 900.0, 900.0, 1, False), ("r1", 1, 50, 0.0, 0.0, 0.0, 0.0, 0, True), ("r2", 1, 0, 500.0, 500.0, 500.0, 500.0, 1, True), (None, 1, 0, 5.0, 5.0, 5.0, 5.0, 1, True)]
    frame = spark.createDataFrame(rows, "reader string, sid int, w int, ffd double, fpd double, rpd double, td double, n_fix int, good boolean")
    found = {(r["reader"], r["sid"], r["w"]): (r["outlier"], r["keep"]) for r in gaze.with_outliers(frame, "reader", "good").collect()}
    values = [10.0] * 20 + [100.0]
    mean = sum(values) / 21
    assert 100 > mean + 3 * math.sqrt(sum((v - mean) ** 2 for v in values) / 21)
    assert found["r1", 1, 20] == ("FFD, FPD, RPD, TD", 0) and found["r1", 1, 3] == ("", 1) and found["r1", 1, 50] == ("", 1)
    assert found["r1", 2, 0] == ("", 0) and found["r2", 1, 0] == ("", 1) and found[None, 1, 0] == ("", 1)


def test_usable_pages(spark):
    words = "alpha beta gamma delta"
    docs = [(1, "a", words * 6), (2, "a", "license"), (3, "a", " ".join([words] * 6)), (4, "a", " ".join(["nowhere"] * 30)), (5, "a", words), (6, "b", " ".join([words] * 6)), (7, "b", None)]
    documents = spark.createDataFrame(docs, "doc_id long, source string, text string")
    tok = spark.createDataFrame([(i, w) for i, _, t in docs if t for w in re.findall(r"\w+", t)], "doc_id long, word string")
    lex = spark.createDataFrame([(w,) for w in words.split()], "word string")
    found = {r["doc_id"]: r["usable"] for r in operators.run("usable_pages", {"tok": tok, "documents": documents, "lex": lex}).collect()}
    assert found == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 1}


def test_clean_rules(spark):
    cases = {
        "One two three four": "", "Too short": "length", "a \ufffd with it on": "broken", "\u0301a with it on": "start", "This is sooo it too": "sequence", "Fill in __ it on": "exercise", "Now you may write": "instruction",
        "This is a cx word": "fragments", "This ßword is it on": "initial", "слово one it two": "letters", "1 2 3 one two": "tokens", " ".join(["word"] * 41): "length"}
    sent = spark.createDataFrame([(k, 1, t) for k, t in enumerate(cases)], "doc_id long, sid long, sentence string")
    found = {r["doc_id"]: r["broken"] for r in operators.run("clean_rules", {"sent": sent}).collect()}
    assert [found[k] for k in range(len(cases))] == list(cases.values())
