import datetime as dt

from pyspark.sql import functions as F

from tessera.streaming import limits


def stream_of(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_lockouts(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, at(60 * i)) for i in range(6)] + [(1, at(5000)), (2, at(0))]
    got = drain(limits.lockouts(stream_of(spark, tmp_path, rows, "key long, ts timestamp")), "lockouts")
    assert sorted((r.key, r.attempt, r.locked) for r in got) == sorted([(1, i, i >= 5) for i in range(1, 7)] + [(1, 1, False), (2, 1, False)])


def test_window_counts(spark, tmp_path):
    rows = [(i % 2, dt.datetime(2024, 1, 1, 0, 0, i)) for i in range(9)]
    stream = stream_of(spark, tmp_path, rows, "user long, ts timestamp_ntz")
    got = drain(limits.window_counts(stream, ["user"], most=4), "counts", "complete")
    assert sorted((r.user, r.n, r.over_limit) for r in got) == [(0, 5, True), (1, 4, False)]


def test_each_batch_and_first_seen(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 1))], "idempotency_key string, at timestamp")
    seen = []
    fresh = limits.first_seen(stream, "idempotency_key", "at", "1 hour")
    limits.each_batch(fresh, lambda df, n: seen.extend(r[0] for r in df.select(F.col("idempotency_key")).collect()), str(tmp_path / "check")).awaitTermination(60)
    assert sorted(seen) == ["a", "b"]
