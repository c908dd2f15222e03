"""What grew faster than its input in the review of round 3."""

import math

import duckdb

from lumenread import operators
from lumenread.functions.dialect import DUCK
from lumenread.operators import subwords, transitions
from lumenread.plans import catalogue as text_queries
from lumenread.plans import text
from lumenread.sources import tables
from lumenread.streaming import fixations

WORDS = ["the cat saw the dog", "the dog", "a", "", None, "the cat sat; a cat sat. The rare bird sat", "the the the cat", "dog a dog a cat saw the rare cat"]


def neighbours(spark, tmp_path):
    rows = [(i, "en", t) for i, t in enumerate(WORDS)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create table documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    return tables.neighbours(spark, str(tmp_path)), lambda sql: {r[0]: r[1:] for r in con.execute(f"with tok_ as ({tables.TOK_SQL}), seq_ as ({tables.DERIVED_SQL['seq']}), {sql.replace('{tok}', 'tok_').replace('{seq}', 'seq_').strip()[5:]}").fetchall()}


def close(found, want):
    assert found.keys() == want.keys() and want
    assert all(len(found[k]) == len(want[k]) and all(math.isclose(x, y, abs_tol=2e-6) for x, y in zip(found[k], want[k], strict=True)) for k in want)


def test_entropies_by_word_known_to_tasks_or_joined(spark, tmp_path):
    seq, oracle = neighbours(spark, tmp_path)
    want = oracle(text.entropy_reduction(DUCK))
    for head in (0, 3, 100):
        close({r["doc_id"]: tuple(r)[1:] for r in operators.run("entropy_reduction", {"seq": seq}, head=head).collect()}, want)
    assert operators.run("entropy_reduction", {"seq": seq.filter("false")}).count() == 0


def test_at_most_so_many_words_are_known_to_all_tasks(spark):
    uses = spark.createDataFrame([(n,) for n in (1, 1, 1, 2, 5, 5, 200_000, 300_000)], "n long")
    assert [transitions.least_count(uses, most) for most in (0, 1, 2, 3, 4, 5, 7, 8)] == [100_001, 100_001, 100_000, 100_000, 5, 2, 2, 1]


def test_surprisal_is_summed_where_pairs_are_counted(spark, tmp_path):
    seq, oracle = neighbours(spark, tmp_path)
    want = oracle(text.lexical_surprisal(DUCK))
    for share in (1, 4, 10_000):
        made = operators.run("lexical_surprisal", {"seq": seq}, share=share)
        close({r["doc_id"]: tuple(r)[1:] for r in made.collect()}, want)
    # tokens are dealt out once, by word, and come back as a row a document
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    assert operators.run("lexical_surprisal", {"seq": seq.filter("false")}).count() == 0


def test_words_cost_by_their_units(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    full = subwords.HEAD
    for name, head in (("subword_first", 50), ("subword_last", 50), ("subword_marked", full)):
        monkeypatch.setattr(subwords.word_costs, "__defaults__", (head,))
        made = subwords.QUERIES[name](spark, sf)
        want = {tuple(r[:3]) if name != "subword_first" else tuple(r[:4]): r[-2:] if name != "subword_marked" else r[-1:] for r in con.execute(subwords.ORACLE[name]).fetchall()}
        n = len(next(iter(want)))
        close({tuple(r)[:n]: tuple(r)[n:] for r in made.collect()}, want)
        # no row a piece is dealt out
        assert "posexplode(pieces" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_sides_are_told_to_all_tasks_and_no_sentence_is_dealt_out(spark):
    for name in ("graded_pairs", "pair_baseline_accuracy"):
        plan = text_queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join Inner" in line and ">= (grade" in line.replace("cast(", "")]
        assert joins and all("strategy=broadcast" in line for line in joins)
        assert "Project [doc_id" in plan and not any("sentence" in line and "n_chars" in line for line in plan.splitlines())


class Counted(tuple):
    """A sample that notes how often it is read."""

    reads = 0

    def __getitem__(self, at):
        Counted.reads += 1
        return tuple.__getitem__(self, at)


def test_a_window_is_read_once_as_it_grows():
    samples = [Counted((float(t), float(t % 7), float(t % 3), False)) for t in range(3000)]
    window, done = fixations.close([], samples, 80.0, 5.0, 60.0, 1.0, False)
    assert len(window) == 3000 and not done and Counted.reads < 10 * 3000
    apart = [Counted((t + 100.0 * (t // 50), float(t), 0.0, False)) for t in range(1000)]
    window, done = fixations.close([], apart, 19.0, 5.0, 10.0, 1.0, True)
    assert not window and [len(w) for w in done] == [20, 20] * 20 or [len(w) for w in done] == [20, 20, 10] * 20
