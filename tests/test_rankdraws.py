"""Ranks taken anew in every draw, by bins, against the oracle's SQL."""

import duckdb
import numpy as np
import pytest

from lumenread import operators
from lumenread.functions.dialect import DUCK
from lumenread.operators import rankdraws
from lumenread.plans import statistics

SCHEMA = "doc_id long, text string, n_chars long"


def documents():
    rng = np.random.default_rng(4)
    rows = [(k, "a" * int(a) + " " * int(b), int(a + b)) for k, (a, b) in enumerate(zip(rng.integers(0, 30, 300), rng.integers(1, 4, 300), strict=True))]
    rows += [(k, "ab cd", 5) for k in range(300, 460)]  # a frequent value of both
    return [*rows, (460, None, 7), (461, None, None), (462, "", 0), (463, None, 7), (464, "no label", 8)]


@pytest.mark.parametrize("share", [7, 40, 100_000])
def test_intervals_of_spearman_by_bins(spark, monkeypatch, share):
    monkeypatch.setattr(rankdraws, "SHARE", share)
    labels = [(k,) for k in range(464)] + [(3,), (None,)]
    docs = spark.createDataFrame(documents(), SCHEMA)
    made = operators.run("bootstrap_spearman", {"documents": docs, "labels": spark.createDataFrame(labels, "doc_id long")}, draws=30)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, n_chars bigint)")
    con.execute("create table labels (doc_id bigint)")
    con.executemany("insert into documents values (?, ?, ?)", documents())
    con.executemany("insert into labels values (?)", labels)
    want = con.execute(statistics.bootstrap_spearman(DUCK, 30).replace("{documents}", "documents").replace("{labels}", "labels")).fetchall()
    assert [r[0] for r in want] == [30] and np.allclose([tuple(r) for r in made.collect()], want, atol=2e-6)
    assert "Window" not in (plan := made._jdf.queryExecution().optimizedPlan().toString()) and "Generate" not in plan


def test_spearman_draws_without_difference(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k,) for k in range(9)], "doc_id long")
    assert tuple(operators.run("bootstrap_spearman", {"documents": nothing, "labels": labels}).first()) == (0, None, None, None)
    same = spark.createDataFrame([(k, "a b", 3) for k in range(9)], SCHEMA)
    assert tuple(operators.run("bootstrap_spearman", {"documents": same, "labels": labels}).first()) == (0, None, None, None)


def test_bins_keep_the_order_of_values():
    values = np.array([0.0, 1.0, 1.5, 2.0, 9.0, np.inf])
    assert rankdraws.bins_of(values, np.array([1.0, 2.0])).tolist() == [0, 1, 2, 3, 4, 4]
    assert rankdraws.bins_of(values, np.zeros(0)).tolist() == [0] * 6
    times = np.array([[1, 0], [2, 1], [0, 3]])
    assert rankdraws.doubled_ranks(np.array([5.0, 5.0, 1.0]), times).tolist() == [[4, 8], [4, 8], [1, 4]]
