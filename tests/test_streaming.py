"""Streams against their batch counterparts."""

from pyspark.sql import functions as F

from lumenry.streaming import events as S


def test_metric_queue_once_each(spark, tmp_path):
    land, out, ck = (str(tmp_path / x) for x in ("land", "out", "ck"))
    rows = [(f"e{i % 7}", "2024-01-01T00:00:00", "p", "run", i) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id string, created_at string, project string, kind string, input_tokens long")
    S.enqueue(df, land)
    S.drain(S.metric_queue(spark, land), out, ck).awaitTermination()
    S.enqueue(df.limit(3), land)
    S.drain(S.metric_queue(spark, land), out, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 7 and got.select("event_id").distinct().count() == 7


def test_watch_and_overflow(spark, tmp_path):
    land = str(tmp_path / "land")
    seen = []
    rows = [("a.py", "modify"), ("a.py", "modify"), (".lumenry/x", "modify"), ("b.py", "access"), ("c.py", "create")]
    spark.createDataFrame(rows, "path string, kind string").withColumn("at", F.lit("2024-01-01T00:00:00")).write.json(land)
    S.watch(S.changes(spark, land), str(tmp_path / "ck"), lambda p, full: seen.append((sorted(r.path for r in p.collect()), full))).awaitTermination()
    assert seen == [(["a.py", "c.py"], False)]
    S.watch(S.changes(spark, land), str(tmp_path / "ck2"), lambda p, full: seen.append(full), overflow=1).awaitTermination()
    assert seen[-1] is True


def test_reindex_requests_are_coalesced(spark, tmp_path):
    land, calls = str(tmp_path / "land"), []
    spark.createDataFrame([("2024-01-01T00:00:00", False), ("2024-01-01T00:00:01", True)], "requested_at string, force boolean").write.json(land)
    S.reindex_requests(spark, land, str(tmp_path / "ck"), calls.append).awaitTermination()
    assert calls == [True]


def test_windows_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    land = str(tmp_path / "land")
    batch = spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(land)
    stream = spark.readStream.schema(batch.schema).parquet(land)
    q = S.tumbling(stream, "ts", "1 hour", late="1 hour").writeStream.format("memory").queryName("tumble").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tumble").collect())) == sorted(map(tuple, S.tumbling(batch, "ts", "1 hour").collect()))
