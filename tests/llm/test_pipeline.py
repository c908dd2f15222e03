"""Every stage of the pipeline against a brute-force version on its own input."""

import corpus_pipeline
from test_dedup import cut_brute, exact_brute, near_brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, toxic = docs.columns, {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(tuple(r) for r in docs.collect())
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = sorted(tuple(r) for r in docs.collect())
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            assert set(after) <= set(before) and len(after) > 0.85 * len(before)
            assert sum(r[0] in toxic for r in after) < 0.5 * len(toxic)
        elif name == "exact_dedup":
            kept = {r[0] for r in exact_brute(before) if r[3]}
            assert after == [r for r in before if r[0] in kept]
        elif name == "minhash_dedup":
            kept = {i for i, _, c in near_brute(before) if i == c}
            assert after == [r for r in before if r[0] in kept]
        elif name == "suffix_dedup":
            want = {i: (n - m) for i, n, m, _, _ in cut_brute(before)}
            assert [r[0] for r in after] == [r[0] for r in before]
            assert all(0 <= want[r[0]] - len(r[1].encode()) <= 3 * len(r[1]) and r[4] == len(r[1]) for r in after)
            packed = {r[0] for r in after}
        else:
            places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in docs.collect())
            assert {r["doc_id"] for r in docs.collect()} == packed
            ends = {}
            for sequence, offset, length in places:
                assert ends.get(sequence, 0) == offset
                ends[sequence] = offset + length
            assert max(ends.values()) <= 4096 and len(ends) <= 1.05 * sum(ends.values()) / 4096 + 1


def test_run_gives_pieces(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns[:2] == ["doc_id", "piece"] and found.count() > 100


def test_other_results_outlive_a_run(spark):
    """Frames made before a run, or by another one, can still be read after it."""
    from lumenread.llm import exact_dedup, minhash_dedup

    queries = [minhash_dedup.query(spark, SF), exact_dedup.query(spark, SF), corpus_pipeline.run(spark, SF)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, SF).count() > 0
    assert [q.count() for q in queries[:2]] == [docs.count()] * 2 and queries[2].count() == corpus_pipeline.run(spark, SF).count() > 100


def test_stages_take_hard_rows(spark, tmp_path):
    """Empty tables, null texts and ids, repeated rows and clashing columns, through all stages."""
    import os

    from helpers import clashing, frame, repeated

    spark.createDataFrame([(3, 0, 1), (0, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, docs in enumerate((clashing(spark, repeated()), frame(spark, []))):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            path = os.path.join(tmp_path, f"{k}-{name}")
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            before, docs = docs, spark.read.parquet(path)
            assert name == "packing" or docs.columns == columns
        assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
        assert (docs.count() > 0) == (k == 0)
