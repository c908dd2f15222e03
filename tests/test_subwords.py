"""Learned sub-words against plain Python, and what a context changes."""

import itertools
import math
import random
from collections import Counter

import pytest

from lumenread.operators import subwords


def learned(counts, rounds):
    """Rounds of merges as they are stated, over single words."""
    words = {w: list(w) for w in counts}
    for _ in range(rounds):
        pairs = Counter()
        for w, p in words.items():
            for two in itertools.pairwise(p):
                pairs[two] += counts[w]
        order = {two: (-n, *two) for two, n in pairs.items() if n >= subwords.SEEN}
        best = {}
        for two, rank in order.items():
            for piece in two:
                best[piece] = min(best.get(piece, rank), rank)
        chosen = {a: b for (a, b), rank in order.items() if best[a] == rank and best[b] == rank}
        if not chosen:
            break
        words = {w: subwords.merged(p, chosen) for w, p in words.items()}
    return words


@pytest.mark.parametrize("seed", range(3))
def test_rounds(spark, seed):
    rng = random.Random(seed)
    counts = {"".join(rng.choice("aab é") for _ in range(rng.randint(1, 9))): rng.randint(1, 9) for _ in range(60)} | {"aaaaa": 7, "aaaa": 4}
    frame = spark.createDataFrame([*counts.items(), (None, 4), ("", 3)], "word string, n long")
    merges, words = subwords.learn(frame, 5)
    assert {r["word"]: r["pieces"] for r in words.collect()} == learned(counts, 5)
    asked = ["aabé", "ba", "", None, "never met"]
    found = spark.createDataFrame([(w,) for w in asked], "w string").select("w", subwords.encoded(subwords.F.col("w"), merges).alias("p")).collect()
    assert all("".join(r["p"]) == (r["w"] or "") for r in found)
    known = spark.createDataFrame([(w,) for w in counts], "w string").select("w", subwords.encoded(subwords.F.col("w"), merges).alias("p")).collect()
    assert {r["w"]: r["p"] for r in known} == learned(counts, 5)


def test_nothing_to_learn(spark):
    merges, words = subwords.learn(spark.createDataFrame([], "word string, n long"))
    assert merges == [] and words.count() == 0
    merges, words = subwords.learn(spark.createDataFrame([("ab", 1)], "word string, n long"))
    assert merges == [] and words.first()["pieces"] == ["a", "b"]


def spoken(spark, rows):
    texts = spark.createDataFrame(rows, "conv_id int, turn int, text string")
    found = subwords.units(texts, ["conv_id"], "turn")
    _, words = subwords.learn(found.groupBy(subwords.F.col("unit").alias("word")).agg(subwords.F.count(subwords.F.lit(1)).alias("n")))
    costs = subwords.piece_costs(found.join(words.selectExpr("word as unit", "pieces"), "unit"), ["conv_id"], "turn")
    return {(r["conv_id"], r["turn"], r["wnum"]): r for r in subwords.first_word_costs(costs, ["conv_id"], "turn").collect()}


def test_a_context_changes_the_first_words_cost(spark):
    base = [(c, 0, "a b") for c in range(5)] + [(c, 1, "a b a") for c in range(5)]
    alone, after = spoken(spark, [*base, (9, 1, "b a")]), spoken(spark, [*base, (9, 0, "a"), (9, 1, "b a")])
    assert alone[9, 1, 1]["surprisal"] != after[9, 1, 1]["surprisal"]
    long = spoken(spark, [*base, (9, 0, "a " * (subwords.BUDGET + 1)), (9, 1, "b a")])
    empty = spoken(spark, [*base, (9, 0, " \n"), (9, 1, "b a"), (9, 2, None)])
    # beyond the budget, or without a word, there is no context: the first word has no blank and follows the start mark
    for found in (long, empty):
        assert found[9, 1, 1]["word"] == "b" and found[9, 1, 1]["pieces"] == 1
    assert (9, 2, 1) not in empty


def test_costs_by_hand(spark):
    # no pair comes twice but ' x' parts: pieces are characters
    found = spoken(spark, [(1, 0, "x"), (1, 1, "y")])
    # pieces in order: x | blank, y; what follows the start mark: x; x: blank; blank: y; three kinds of pieces
    assert found[1, 0, 1]["surprisal"] == round(-math.log(2 / 4), 6)
    # the blank by itself ends where the word begins: it is the context's
    assert found[1, 1, 1]["surprisal"] == round(-math.log(2 / 4), 6) and found[1, 1, 1]["pieces"] == 1
