"""The segmenter against all splits, and its training against plain Python."""

import itertools
import math
from collections import Counter

import pytest

from lumenread.functions import segment

WORDS = {"walking": 3, "walked": 2, "talking": 4, "talked": 2, "jumping": 2, "jumped": 3, "walk": 5, "xylo": 2, "ing": 1}


def splits(word):
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        parts, start = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                parts.append(word[start:k])
                start = k
        yield [*parts, word[start:]]


def subs(word):
    return {word} | {word[a : a + n] for a in range(len(word)) for n in range(1, segment.LONGEST + 1) if a + n <= len(word)}


def plain(counts, rounds):
    """Training as it is stated: prices, splits at these prices, uses, until the code stops getting shorter."""
    letters = Counter(c for w in counts for c in w)
    total_letters = sum(letters.values()) + len(counts) + 1
    end, unknown = -math.log(len(counts) / total_letters), math.log(total_letters)
    spelling = lambda p: sum(-math.log(letters[c] / total_letters) for c in p) + end

    def priced(uses):
        total = sum(uses.values())
        length = sum(spelling(p) for p in uses) + sum(-u * math.log(u / total) for u in uses.values())
        return {p: -math.log(u / total) + spelling(p) / u for p, u in uses.items()}, length, total

    uses, types = Counter(), Counter()
    for w, n in counts.items():
        for p in subs(w):
            uses[p] += n
            types[p] += 1
    prices, _, total = priced({p: u for p, u in uses.items() if types[p] > 1 or p in counts or len(p) == 1})
    worst, best, lengths = math.log(total) + unknown + end, prices, []
    for _ in range(rounds):
        uses = Counter()
        for w, n in counts.items():
            for p in segment.cheapest(w, prices, worst):
                uses[p] += n
        prices, length, _ = priced(uses)
        if lengths and length >= lengths[-1] - 1e-9 * abs(lengths[-1]):
            break
        best, lengths = prices, [*lengths, length]
    return best, worst, lengths


@pytest.mark.parametrize("rounds", [1, 2, 8])
def test_training(spark, rounds):
    frame = spark.createDataFrame([*WORDS.items(), (None, 3), ("", 2)], "word string, n long").selectExpr("*", "1 as part", "1 as uses")
    found = segment.train(frame, rounds)
    prices, worst, lengths = plain(WORDS, rounds)
    assert found.lengths == pytest.approx(lengths) and found.worst == pytest.approx(worst)
    assert {r["part"]: r["price"] for r in found.prices.collect()} == pytest.approx(prices)
    told = {r["word"]: r["parts"] for r in found.split(spark.createDataFrame([(w,) for w in [*WORDS, "talks", "walking", "ß", "", None]], "word string")).collect()}
    assert told == {w: segment.cheapest(w, prices, worst) if w else [] for w in [*WORDS, "talks", "ß", "", None]}
    assert all(a > b for a, b in itertools.pairwise(found.lengths))


def test_cheapest_of_all_splits():
    prices, worst, _ = plain(WORDS, 1)
    cost = lambda parts: sum(prices.get(p, worst if len(p) == 1 else math.inf) for p in parts)
    for word in ("walking", "talked", "xwalked", "z", "jumpwalk"):
        found = segment.cheapest(word, prices, worst)
        assert "".join(found) == word and cost(found) == pytest.approx(min(map(cost, splits(word))))
    long = "w" * 40
    assert segment.cheapest(long, {long: 1.0}, 9.0) == [long]


def test_shared_parts_are_found(spark):
    stems, endings = ["walk", "talk", "jump", "climb", "print"], ["ing", "ed", "er", "s"]
    frame = spark.createDataFrame([(s + e, 5) for s in stems for e in endings], "word string, n long")
    told = {r["word"]: r["parts"] for r in segment.train(frame).split(frame).collect()}
    assert told["climbing"] == ["climb", "ing"] and told["printer"] == ["print", "er"]


def test_nothing_to_learn(spark):
    found = segment.train(spark.createDataFrame([], "word string, n long"))
    assert found.prices.count() == 0
    assert found.split(spark.createDataFrame([("ab",)], "word string")).first()["parts"] == ["a", "b"]
    tokens = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "doc_id int, word string")
    assert [(r["word"], r["n"]) for r in segment.word_counts(tokens).collect()] == [("a", 2)] and segment.word_counts(tokens, 1).count() == 0
