"""Streams over whole tables against plain reads of them."""

from pyspark.sql import functions as F

from lumenread.streaming import queries

SF = "/root/testdata/sf0.001"


def test_uploads_of_a_table(spark):
    found = sorted(r["sid"] for r in queries.live_uploads(spark, SF).collect())
    clicks = spark.read.parquet(f"{SF}/clicks.parquet").filter("click_id is not null and arrived_at is not null")
    want = sorted(str(r["click_id"]) for r in clicks.select("click_id").distinct().collect())
    assert found == want and clicks.count() >= len(want)  # in one batch a click is one row, however late its retries are


def test_fixations_of_a_table(spark):
    from test_fixation_stream import plain

    found = queries.live_fixations(spark, SF)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != queries.fixations.PROVIDER
    events = spark.read.parquet(f"{SF}/events.parquet").select(
        "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.get_json_object("props", "$.k").cast("int") % 8 * 10.0).alias("x"), F.col("value").alias("y")).dropna().collect()
    last = max(r["t"] for r in events) - 86400
    told = {}
    for r in found.collect():
        told.setdefault(r["key"], []).append((r["start_t"], r["end_t"], r["x"], r["y"], r["samples"]))
    bounds = {"spread": 80.0, "gap": 3 * 86400.0, "least": 60.0, "interval": 3600.0}
    total = 0
    for user in {r["user_id"] for r in events}:
        # samples of one time are in the order of their place; the watermark hasn't passed the last day
        own = sorted({(r["t"], r["x"], r["y"]) for r in events if r["user_id"] == user and r["t"] < last})
        want = plain_with(plain, own, bounds)
        mine = sorted(told.get(user, []))
        total += len(mine)
        assert mine == want[: len(mine)] and len(mine) >= len(want) - 2
    assert total > 50


def plain_with(plain, samples, bounds):
    import test_fixation_stream as module

    before, module.BOUNDS = module.BOUNDS, bounds
    try:
        return plain(samples)
    finally:
        module.BOUNDS = before
