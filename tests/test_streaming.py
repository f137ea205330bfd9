"""Streams against the batch operators on the same rows."""

from pyspark.sql import functions as F

from lexiframe.operators import timeline
from lexiframe.streaming import streams


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def source(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    return e, streams.event_stream(spark, str(tmp_path / "in"), e.schema)


def test_windows_and_sessions(spark, sf_dir, tmp_path):
    e, s = source(spark, sf_dir, tmp_path)
    batch = e.withColumn("ts", F.col("ts").cast("timestamp"))
    for name, f in (("t", lambda x: streams.tumbling(x, "1 day", ["event_type"])), ("h", lambda x: streams.hopping(x, "2 days", "1 day", [])), ("z", lambda x: streams.sessions(x, "6 hours", ["user_id"]))):
        got = {repr(r) for r in run(f(s), name, "append").collect()}
        want = {repr(r) for r in f(batch).collect()}
        assert got <= want and len(got) >= 0.8 * len(want)


def test_runs_in_state(spark, sf_dir, tmp_path):
    e, s = source(spark, sf_dir, tmp_path)
    got = sorted(map(tuple, run(streams.run_lengths(s), "runs", "append").collect()))
    r = timeline.runs(e, ["user_id"], ["ts", "event_id"], "event_type")
    per = r.groupBy("user_id", "run_id").agg(F.first("event_type").alias("label"), F.count("*").alias("n"))
    last = per.groupBy("user_id").agg(F.max("run_id").alias("m"))
    closed = per.join(last, "user_id").where("run_id < m").select("user_id", "label", "n")
    assert got == sorted(map(tuple, closed.collect()))
