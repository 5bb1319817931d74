from tidegrid.streaming.bins import stream_bin_counts


def test_stream_matches_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.select("event_type", "ts").repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_type string, ts timestamp_ntz").parquet(f"{tmp_path}/in")
    q = stream_bin_counts(stream, "event_type", "ts").writeStream.outputMode("complete").format("memory").queryName("bins").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        got = {(r.event_type, r.bin): r.demand for r in spark.sql("select * from bins").collect()}
    finally:
        q.stop()
    from tidegrid.operators.panel import bin_counts

    assert got == {(r.event_type, r.bin): r.demand for r in bin_counts(events, "event_type", "ts", 3600).collect()}


def test_stream_panel_equals_batch(spark, tmp_path):
    """Shuffled, late rows in several batches give the dense panel with lags that the batch gives."""
    import random
    from collections import Counter
    from datetime import datetime, timedelta

    from tidegrid.streaming.panel import stream_panel

    rng, start = random.Random(3), datetime(2024, 1, 1)
    events = sorted((start + timedelta(minutes=rng.randrange(60 * 40)), rng.choice("aaabbc")) for _ in range(300))
    events = [e for e in events if not (e[1] == "b" and 10 <= (e[0] - start).seconds // 3600 <= 14)]
    late = sorted(range(len(events)), key=lambda i: events[i][0] + timedelta(minutes=rng.uniform(0, 110)))
    parts = [late[i : i + 60] for i in range(0, len(late), 60)]
    for k, part in enumerate(parts):
        rows = [(events[i][1], events[i][0]) for i in part]
        rows += [(None, start), ("a", None)] if k == 0 else []
        spark.createDataFrame(rows, "key string, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.createDataFrame([("end", start + timedelta(hours=50))], "key string, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/in/z")
    stream = spark.readStream.schema("key string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = stream_panel(stream, "key", "ts", late="2 hours", lags=(1, 3))
    q = out.writeStream.outputMode("append").format("memory").queryName("panel").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.key, r.bin): (r.demand, r.lag_1, r.lag_3) for r in spark.sql("select * from panel where bin < timestamp_ntz'2024-01-02 16:00:00'").collect()}
    want = {}
    for key in "abc":
        n = Counter((t - start).seconds // 3600 + 24 * (t - start).days for t, k in events if k == key)
        first = min(n)
        for h in range(first, 40):
            lag = lambda k, h=h: float(n[h - k]) if h - k >= first else None
            want[key, start + timedelta(hours=h)] = (float(n[h]), lag(1), lag(3))
    assert got == want


def test_status(spark):
    from tidegrid.sources import status

    spark.sparkContext.setJobGroup("probe", "counted by the test")
    spark.range(0, 1000, 1, 3).selectExpr("id % 7 as k").groupBy("k").count().collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    found = status.stages(spark, "probe").where("status = 'COMPLETE'").collect()
    assert {r.tasks for r in found} >= {3} and all(r.completed_tasks == r.tasks and r.failed_tasks == 0 for r in found) and sum(r.shuffle_write_bytes for r in found) > 0
    (driver,) = [r for r in status.executors(spark).collect() if r.executor == "driver"]
    assert driver.active and driver.cores == 4 and driver.completed_tasks > 0
    assert status.stages(spark, "no such group").count() == 0
