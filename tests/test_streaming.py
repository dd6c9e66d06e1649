"""Streams in several batches: late rows, sessions, and state kept between batches."""

import datetime as dt

from pyspark.sql import functions as F

from factweave.functions import scalar
from factweave.streaming.replica import Windows, changes, session_windows

SCHEMA = "key string, ts timestamp, value long"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def add(spark, folder, rows):
    spark.createDataFrame([(k, at(m), v) for k, m, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_windows_and_late_rows(spark, tmp_path):
    base = f"file://{tmp_path}"
    kept = Windows(spark, f"{base}/windows", "ts", "10 minutes", "20 minutes", ["key"], n=F.count("*"), top=F.max("value"))

    def follow():
        kept.follow(spark.readStream.schema(SCHEMA).parquet(f"{base}/in"), f"{base}/checkpoint").awaitTermination()

    add(spark, f"{base}/in", [("a", 1, 5), ("a", 9, 7), ("b", 12, 1)])
    follow()
    add(spark, f"{base}/in", [("a", 2, 9), ("b", 100, 2)])  # in order enough for the watermark of minute 12
    follow()
    add(spark, f"{base}/in", [("a", 3, 99), ("b", 95, 4)])  # the first is later than the watermark of minute 100 allows
    follow()
    found = {(r["start"], r["key"]): (r["n"], r["top"]) for r in kept.current().collect()}
    assert found == {(at(0), "a"): (3, 9), (at(10), "b"): (1, 1), (at(100), "b"): (1, 2), (at(90), "b"): (1, 4)}


def test_session_windows_on_a_stream(spark, tmp_path):
    base = f"file://{tmp_path}"
    add(spark, f"{base}/in", [("a", 0, 1), ("a", 4, 1), ("a", 30, 1), ("b", 3, 1)])
    out = session_windows(spark.readStream.schema(SCHEMA).parquet(f"{base}/in"), "ts", "5 minutes", "1 minute", ["key"], n=F.count("*"))
    out = out.select("key", F.col("window.start").alias("start"), "n")
    query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    query.start().awaitTermination()
    add(spark, f"{base}/in", [("c", 500, 1)])  # moves the watermark, which closes the sessions
    query.start().awaitTermination()
    found = sorted((r["key"], r["start"], r["n"]) for r in spark.read.parquet(f"{base}/out").collect())
    assert found == [("a", at(0), 2), ("a", at(30), 1), ("b", at(3), 1)]


def test_changes_keep_state(spark, tmp_path):
    base = f"file://{tmp_path}"
    add(spark, f"{base}/in", [("a", 1, 5), ("a", 2, 5), ("a", 3, 6), ("b", 1, 1)])
    out = changes(spark.readStream.schema(SCHEMA).parquet(f"{base}/in"), "key", "ts", "value")
    query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    query.start().awaitTermination()
    add(spark, f"{base}/in", [("a", 4, 6), ("a", 5, 7), ("b", 9, 1)])
    query.start().awaitTermination()
    found = sorted((r["key"], r["before"] if r["before"] is not None else -1, r["now"]) for r in spark.read.parquet(f"{base}/out").collect())
    assert found == [("a", -1, 5), ("a", 5, 6), ("a", 6, 7), ("b", -1, 1)]


def test_truth(spark):
    df = spark.createDataFrame([(1, 2, 3, True), (3, 2, 1, False), (None, 2, 2, None)], "a int, b int, c int, d boolean")
    a, b, c, d = map(F.col, "abcd")
    rows = df.select(
        scalar.chain("<", a, b, c).alias("up"), scalar.truthy(a).alias("some"), scalar.every(d, b > 1).alias("every"), scalar.some(d, c == 1).alias("any"),
        scalar.negated(d).alias("no"), scalar.choose(d, a).alias("chosen"),
    ).collect()
    assert [tuple(r) for r in rows] == [(True, True, True, True, False, 1), (False, True, False, True, True, None), (False, False, False, False, True, None)]
