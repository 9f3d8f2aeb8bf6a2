"""Streams of job events give what the same rows give at once."""

from pyspark.sql import functions as F

from orograph.streaming import jobs

DATA = "/root/testdata/sf0.001/events.parquet"


def drain(spark, tmp_path, f, name, mode):
    source = spark.read.parquet(DATA)
    source.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windowed_counts(spark, tmp_path):
    got = drain(spark, tmp_path, lambda s: jobs.windowed_counts(s, late="3650 days"), "counts", "complete")
    want = jobs.windowed_counts(spark.read.parquet(DATA))
    key = lambda df: {(r.start, r.event_type): r.n for r in df.collect()}
    assert key(got) == key(want)


def test_sessions_cover_every_event(spark):
    assert jobs.sessions(spark.read.parquet(DATA)).agg(F.sum("n")).first()[0] == spark.read.parquet(DATA).count()


def test_log_tail(spark, tmp_path):
    got = drain(spark, tmp_path, lambda s: jobs.log_tail(s.select("user_id", "event_id", "event_type", "ts"), keep=5, late="3650 days"), "tail", "update")
    last = {}
    for r in got.collect():
        if r.user_id not in last or r.last_id >= last[r.user_id].last_id:
            last[r.user_id] = r
    events = spark.read.parquet(DATA)
    want = {r.user_id: (r.m, min(r.n, 5)) for r in events.groupBy("user_id").agg(F.max("event_id").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    assert {k: v[0] for k, v in want.items()} == {k: v.last_id for k, v in last.items()}
    assert all(r.lines <= 5 for r in got.collect())
