"""Paged services, questions asked once, and sheets: what is lost and comes again changes nothing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lumenread.sources import services
from lumenread.streaming import gaze as streaming

SCHEMA = "id long, name string"


def service(log, fails=()):
    """A service of three pages of two books that notes each call; pages in fails raise after the note."""

    def fetch(page):
        with open(log, "a") as file:
            file.write(f"{page}\n")
        if page in fails:
            raise OSError("the line went dead")
        return json.dumps({"pages": 3, "data": [{"id": page * 10 + k, "name": None if k else "x"} for k in range(2)]}) if page <= 3 else None

    return fetch, lambda body: json.loads(body)["pages"], lambda body: iter([(b["id"], b["name"]) for b in json.loads(body)["data"]])


def calls(log):
    return sorted(open(log).read().split()) if os.path.exists(log) else []


def test_pages_are_fetched_once(spark, tmp_path):
    log, cache = str(tmp_path / "log"), str(tmp_path / "cache")
    with pytest.raises(Exception, match="dead"):
        services.paged(spark, *service(log, {3}), SCHEMA, cache).collect()
    first = calls(log)
    assert first.count("1") == 1 and first.count("2") <= 1
    found = services.paged(spark, *service(log), SCHEMA, cache)
    for _ in range(2):
        assert sorted(tuple(r) for r in found.collect()) == [(p * 10 + k, None if k else "x") for p in (1, 2, 3) for k in range(2)]
    # what was there stayed: pages that had come weren't asked for again
    assert calls(log).count("1") == 1 and calls(log).count("2") == 1 and calls(log).count("3") == first.count("3") + 1


def test_a_service_without_pages(spark, tmp_path):
    none = services.paged(spark, lambda page: None, lambda body: 1, lambda body: iter(()), SCHEMA, str(tmp_path / "cache"))
    assert none.count() == 0 and none.columns == ["id", "name"]


def test_items_are_asked_once(spark, tmp_path):
    log, kept = str(tmp_path / "log"), str(tmp_path / "answers")

    def answering(salt, dies_at=None):
        def ask(frames):
            for frame in frames:
                for _, row in frame.iterrows():
                    with open(log, "a") as file:
                        file.write(f"{row['id']}\n")
                    if row["id"] == dies_at:
                        raise RuntimeError("no answer")
                    if row["text"] != "quiet":
                        yield frame[frame["id"] == row["id"]].assign(answer=row["text"] + salt)[["id", "answer"]]

        return ask

    items = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "z"), (3, "quiet")], "id long, text string").repartition(1)
    with pytest.raises(Exception, match="no answer"):
        services.asked_once(items, kept, answering("1", dies_at=2), "id long, answer string").collect()
    found = services.asked_once(items, kept, answering("2"), "id long, answer string")
    told = dict(sorted(tuple(r) for r in found.collect()))
    assert set(told) == {1, 2} and told[2] == "b2"
    assert dict(sorted(tuple(r) for r in found.collect())) == told
    assert calls(log).count("1") == 1 and calls(log).count("2") == 2 and calls(log).count("3") >= 2  # 2 failed once, 3 never answers
    assert services.asked_once(items.limit(0), kept, answering("3"), "id long, answer string").count() == 0


def test_a_sheet_takes_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "sheet")
    rows = spark.createDataFrame([(1, "x" * 60_000), (2, None), (3, "é\n")], "id int, note string").repartition(2)
    services.append_sheet(rows, path)
    found = {r["id"]: r["note"] for r in services.read_sheet(spark, path, "id int, note string").collect()}
    assert found == {1: "x" * 49_000 + "…TRUNCATED", 2: "", 3: "é\n"}
    broken = rows.withColumn("note", F.when(F.col("id") == 2, F.raise_error(F.lit("broken row"))).otherwise(F.col("note")))
    with pytest.raises(Exception, match="broken row"):
        services.append_sheet(broken, path)
    assert services.read_sheet(spark, path, "id int, note string").count() == 3
    services.append_sheet(rows.limit(1), path)
    services.append_sheet(rows.limit(0), path)
    assert services.read_sheet(spark, path, "id int, note string").count() == 4
    assert services.read_sheet(spark, str(tmp_path / "none"), "id int").count() == 0


def test_a_batch_that_comes_again_is_appended_once(spark, tmp_path):
    writer = services.StreamWriter(str(tmp_path / "sheet"))
    rows = spark.createDataFrame([(1, "a")], "id int, note string").collect()
    for turn in range(2):  # the batch is written again, as after a loss between commit and the stream's own note of it
        writer.commit([writer.write(iter(rows)), writer.write(iter(())), None], 7)
        assert len([f for f in os.listdir(tmp_path / "sheet" / "parts") if f.endswith(".json")]) == 1, turn
    writer.abort([writer.write(iter(rows)), None], 8)
    assert services.read_sheet(spark, str(tmp_path / "sheet"), "id int, note string").count() == 1
    assert len([f for f in os.listdir(tmp_path / "sheet" / "parts") if f.endswith(".json")]) == 1


def test_a_stream_of_samples_to_a_sheet(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"key": 1, "t": 0.5, "x": 1, "y": 2, "valid": true}\n{"key": 1, "t": 0.6, "valid": false, "reason": "blink"}\n')
    for turn in (1, 2):
        rows = streaming.valid_samples(streaming.sample_source(spark, str(tmp_path / "in")))
        query = services.stream_sheet(rows, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(90)
        found = services.read_sheet(spark, str(tmp_path / "out"), "key long, t double, x double").collect()
        assert sorted(tuple(r) for r in found) == [(1, 0.5, 1.0), (1, 0.7, 3.0)][:turn]
        (tmp_path / "in" / "2.json").write_text('{"key": 1, "t": 0.7, "x": 3, "y": 2, "valid": true}\n')


def test_trials_of_several_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_text("pid,practice,sid,n_words,rt_ms,text\np1,0,1,3,90,\"a, b\"\np1,0,1,3,10,later\np1,1,1,3,5,c\n")
    (tmp_path / "b.json").write_text(json.dumps({"version": 2, "results": [
        {"type": "intro", "pid": "p9", "practice": 0, "sid": 1}, {"type": "trial", "pid": "p1", "practice": 0, "sid": 1, "n_words": 3, "rt_ms": 1},
        {"type": "trial", "pid": "p2", "practice": False, "sid": 1, "n_words": 4, "rt_ms": 7.5, "extra": "e"}, {"type": "trial", "pid": "p2", "practice": False, "sid": 1, "n_words": 4, "rt_ms": 1}]}))
    found = services.trials(spark, [f"{tmp_path}/a.csv"], [f"{tmp_path}/b.json"])
    # of repeated trials the first row of the first file stays, whatever its time
    assert sorted((r["pid"], r["practice"], r["sid"], r["rt_ms"]) for r in found.collect()) == [("p1", 0, "1", 90.0), ("p1", 1, "1", 5.0), ("p2", 0, "1", 7.5)]
    assert {r["text"] for r in found.collect()} == {"a, b", "c", None}
