from visitloom.sources.packages import append_results
from visitloom.streaming import incremental


def test_stream_appends_once(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts", "event_type")
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    events.filter("event_id % 2 = 0").write.parquet(source)
    for extra in (None, "event_id % 3 = 0"):
        if extra:
            events.filter(extra).write.mode("append").parquet(source)
        incremental.append_new(incremental.follow(spark, source, events.schema), target, "event_id", f"{tmp_path}/cp").awaitTermination(120)
    out = spark.read.parquet(target)
    want = events.filter("event_id % 2 = 0 OR event_id % 3 = 0").count()
    assert out.count() == want == out.select("event_id").distinct().count()
    assert append_results(events.limit(5), target, "event_id").count() >= want


def test_windowed_counts(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select("ts", "event_type")
    events.write.parquet(f"{tmp_path}/in")
    counts = incremental.windowed_counts(incremental.follow(spark, f"{tmp_path}/in", events.schema), "ts", ["event_type"])
    q = counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(rows) FROM counted").first()[0] == events.count()
