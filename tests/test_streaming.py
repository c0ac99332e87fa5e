import datetime

from sitescope.streaming import limits


def test_failure_limiter(spark, tmp_path):
    t = datetime.datetime(2026, 1, 1)
    rows = [("a", t + datetime.timedelta(seconds=s), ok) for s, ok in ((0, False), (10, False), (20, False), (25, True), (30, False))] + [("b", t, False)]
    spark.createDataFrame(rows, "key string, ts timestamp, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp, ok boolean").parquet(str(tmp_path / "in"))
    q = limits.failure_limiter(stream, 300, 3).writeStream.format("memory").queryName("blocked").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    got = sorted((r["key"], r["failures"], r["blocked"]) for r in spark.table("blocked").collect())
    assert got == [("a", 0, False), ("a", 1, False), ("a", 1, False), ("a", 2, False), ("a", 3, True), ("b", 1, False)]


def test_replace_days(spark, tmp_path):
    schema = "integration_id int, day date, clicks int"
    day = datetime.date
    out, src = str(tmp_path / "out"), str(tmp_path / "src")
    spark.createDataFrame([(1, day(2026, 1, 1), 1), (1, day(2026, 1, 2), 1)], schema).write.mode("append").parquet(src)
    run = lambda: limits.replace_days(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp")).start().awaitTermination(60)
    run()
    spark.createDataFrame([(1, day(2026, 1, 2), 5)], schema).write.mode("append").parquet(src)
    run()
    assert sorted((r["day"].day, r["clicks"]) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 5)]


def test_windows(spark, tmp_path):
    t = datetime.datetime(2026, 1, 1)
    spark.createDataFrame([("a", t), ("a", t + datetime.timedelta(minutes=1)), ("a", t + datetime.timedelta(minutes=30))], "key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = limits.windowed_counts(stream, "ts", "key").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["events"] for r in spark.table("counts").collect()) == [1, 2]


def test_claim_and_stale(spark):
    t = datetime.datetime(2026, 1, 1)
    rows = spark.createDataFrame([(1, "queued", t), (2, "queued", t - datetime.timedelta(1)), (3, "running", t)], "id int, status string, created_at timestamp")
    assert {r["id"]: r["status"] for r in limits.claim(rows).collect()} == {1: "queued", 2: "running", 3: "running"}
