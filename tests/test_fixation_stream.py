"""The live fixation detector: as they close, restarts, late samples, trials without an end."""

import random
import statistics

import pytest

from lumenread.streaming import fixations

BOUNDS = {"spread": 20.0, "gap": 0.5, "least": 0.3, "interval": 0.1}


@pytest.fixture
def stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", fixations.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def plain(samples):
    """Fixations of one trial's samples in order, by the window rule over all of them."""
    out, i = [], 0
    while i < len(samples):
        j = i
        while j + 1 < len(samples):
            xs, ys = [s[1] for s in samples[i : j + 2]], [s[2] for s in samples[i : j + 2]]
            if samples[j + 1][0] - samples[j][0] > BOUNDS["gap"] or max(xs) - min(xs) + max(ys) - min(ys) > BOUNDS["spread"]:
                break
            j += 1
        if samples[j][0] - samples[i][0] + BOUNDS["interval"] >= BOUNDS["least"]:
            if j > i:
                own = samples[i : j + 1]
                out.append((own[0][0], round(own[-1][0] + BOUNDS["interval"], 6), statistics.median(s[1] for s in own), statistics.median(s[2] for s in own), len(own)))
            i = j + 1
        else:
            i += 1
    return out


def trial(seed, start, n=60):
    rng, x, y, out = random.Random(seed), 0.0, 0.0, []
    for k in range(n):
        if rng.random() < 0.12:
            x, y = rng.choice([0, 100, 200]), rng.choice([0, 50])
        out.append((round(start + k / 10 + (3 if k > 45 else 0), 3), float(x + rng.randint(0, 9)), float(y + rng.randint(0, 9))))
    return out


class Feed:
    """Batches of samples as files, and what has come out after each."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0
        (path / "in").mkdir()

    def run(self, *batches, **more):
        """Add batches, one file and trigger each, in a query that is started anew on the same checkpoint."""
        schema = "key long, t double, x double, y double, off boolean"
        for rows in batches:
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(self.path / "in" / f"b{self.n:03d}"))
            self.n += 1
            source = self.spark.readStream.schema(schema).parquet(str(self.path / "in" / "*"))
            query = fixations.fixation_stream(source, **BOUNDS, late="1 second", **more).writeStream.format("parquet").option("path", str(self.path / "out")).option(
                "checkpointLocation", str(self.path / "cp")).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
        return self.out()

    def out(self):
        found = {}
        for r in self.spark.read.schema(fixations.SCHEMA).parquet(str(self.path / "out")).collect():
            found.setdefault(r["key"], []).append((r["start_t"], round(r["end_t"], 6), r["x"], r["y"], r["samples"]))
        return {k: sorted(v) for k, v in found.items()}


def test_closing_restarts_late_and_abandoned(stateful, tmp_path):
    feed = Feed(stateful, tmp_path)
    one, two = trial(1, 1000.0), trial(2, 1000.0)
    cut = 35
    swapped = [*one[: cut - 3], one[cut - 1], one[cut - 3], one[cut - 2]]  # within what may be late
    rows = lambda key, samples: [(key, *s, False) for s in samples]
    before = feed.run([*rows(1, swapped), *rows(2, two[:cut])], [(9, one[cut - 1][0] + 0.9, 0.0, 0.0, False)])
    # fixations that have closed by then are out, though neither trial has ended
    assert before[1] and before[1] == plain(one)[: len(before[1])]
    last = one[-1][0]
    # each run is a new query on the old checkpoint; a sample from long ago changes nothing, trial 1 ends, trial 2 never does
    feed.run([*rows(1, one[cut:]), *rows(2, two[cut:]), (1, last + 0.01, None, None, True)])
    feed.run([(1, one[3][0] + 0.005, 500.0, 500.0, False), (9, last + 5, 0.0, 0.0, False)])
    feed.run([(9, last + 6, 0.0, 0.0, False)])
    found = feed.out()
    assert found[1] == plain(one)
    open_ = plain(two)
    assert found[2] == open_[: len(found[2])]
    # long after its last sample the abandoned trial's timer ends it
    feed.run([(9, last + 300, 0.0, 0.0, False)], [(9, last + 301, 0.0, 0.0, False)])
    assert feed.out()[2] == open_ and feed.out()[1] == plain(one)


def test_samples_that_are_not_there(stateful, tmp_path):
    feed = Feed(stateful, tmp_path)
    feed.run([(None, 1.0, 1.0, 1.0, False), (1, None, 1.0, 1.0, False), (1, 1.0, None, 1.0, None), (1, 2.0, 1.0, 1.0, False), (1, 2.0, 1.0, 1.0, False)], [(1, 900.0, 0.0, 0.0, True)], [(2, 2000.0, 0.0, 0.0, False)])
    assert 1 not in feed.out()  # one sample, though it came twice, makes no fixation


def test_window_rule_piece_by_piece():
    samples = [(*s, False) for s in trial(5, 0.0)]
    window, done = [], []
    for s in samples:
        window, more = fixations.close(window, [s], BOUNDS["spread"], BOUNDS["gap"], BOUNDS["least"], BOUNDS["interval"], False)
        done += more
    _, more = fixations.close(window, [], BOUNDS["spread"], BOUNDS["gap"], BOUNDS["least"], BOUNDS["interval"], True)
    assert [(w[0][0], len(w)) for w in done + more] == [(f[0], f[4]) for f in plain([s[:3] for s in samples])]
