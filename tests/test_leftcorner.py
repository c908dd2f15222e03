"""Left-corner decisions against parses worked out by hand, and what words cost by them."""

import math

from pyspark.sql import functions as F

from lumenread.operators import leftcorner, trees


def told(text):
    return [f"{pred} : {resp}" for _, pred, resp in leftcorner.decisions(trees.parse(text))]


def test_one_word():
    assert told("(S (NP (NN dogs)))") == ["F 1 NN : 0", "P 1 NN 0 : NN", "W NN : dogs"]


def test_by_hand_left_and_right():
    # (S (NP (D the) (N dog)) (VP (V saw) (NP (D a) (N cat))))
    assert told("(S (NP (D the) (N dog)) (VP (V saw) (NP (D a) (N cat))))") == [
        # the: new below S; its parent NP isn't S: a component NP that awaits N
        "F 1 S : 1", "P 1 S 1 : D", "W D : the", "J 1 S D : 0", "A 1 S D : NP", "B 1 NP D : N",
        # dog: what NP awaits; NP is the left child of the awaited S: TOP awaits VP
        "F 2 N : 0", "P 2 N 0 : N", "W N : dog", "J 1 S NP : 1", "B 1 TOP NP : VP",
        # saw: new below VP, its left child: TOP awaits the object
        "F 1 VP : 1", "P 1 VP 1 : V", "W V : saw", "J 1 VP V : 1", "B 1 TOP V : NP",
        "F 1 NP : 1", "P 1 NP 1 : D", "W D : a", "J 1 NP D : 1", "B 1 TOP D : N",
        "F 1 N : 0", "P 1 N 0 : N", "W N : cat"]


def test_by_hand_deep_left_and_many_children():
    # (S (X (Y (A a) (B b)) (C c)) (D d)): components nest only while a left branch is within a left branch
    assert told("(S (X (Y (A a) (B b)) (C c)) (D d))") == [
        "F 1 S : 1", "P 1 S 1 : A", "W A : a", "J 1 S A : 0", "A 1 S A : Y", "B 1 Y A : B",
        "F 2 B : 0", "P 2 B 0 : B", "W B : b", "J 1 S Y : 0", "A 1 S Y : X", "B 1 X Y : C",
        "F 2 C : 0", "P 2 C 0 : C", "W C : c", "J 1 S X : 1", "B 1 TOP X : D", "F 1 D : 0", "P 1 D 0 : D", "W D : d"]
    # four children: the rest after each is an S again
    assert [x for x in told("(S (A a) (B b) (C c) (D d))") if x[0] in "B"] == ["B 1 TOP A : S", "B 1 TOP B : S", "B 1 TOP C : D"]


def test_trees_without_words_and_long_ones(spark):
    assert told("(S )") == []
    many = "(S " + " ".join(f"(A w{k})" for k in range(5000)) + ")"
    assert sum(x.startswith("W") for x in told(many)) == 5000
    deep = "(S " * 3000 + "(A a)" + " (B b))" * 3000
    assert sum(x.startswith("W") for x in told(deep)) == 3001
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "(S (A a)")], "id int, text string")
    assert leftcorner.decision_table(rows, "id").count() == 0


def test_costs_belong_to_the_word_they_surround(spark):
    rows = spark.createDataFrame([(1, "(S (A a) (B b))"), (2, "(S (A a) (B b))"), (3, "(S (A a) (S (A a) (B b)))"), (4, "(S (X x) (B b))")], "id int, text string")
    steps = leftcorner.decision_table(rows, "id")
    table = leftcorner.conditional(steps.filter("id < 4"))
    found = {(r["id"], r["wnum"]): (r["surprisal"], r["unseen"]) for r in leftcorner.surprisal(steps, table, "id", longest=2).collect()}
    # F 1 S is always 1, P 1 S 1 always A, J always 1; B 1 TOP A is B in three of four cases
    assert found[1, 1] == (round(-math.log(3 / 4), 5), 0) and found[1, 2] == (0.0, 0)
    assert (3, 1) not in found  # three words
    # X: P is unseen; J 1 S X and B 1 TOP X as well
    assert found[4, 1] == (round(-3 * math.log(1e-6), 5), 3)


def test_lines_there_and_back(spark):
    table = spark.createDataFrame([("P 1 S 1", "A", 0.25), ("W .", ".", 1.0), ("F 1 : x", "1", 1e-9)], "pred string, resp string, p double")
    back = leftcorner.read_lines(leftcorner.lines_of(table).unionByName(spark.createDataFrame([("nothing",)], "line string")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))
    assert leftcorner.conditional(table.withColumn("n", F.lit(1))).count() == 3
