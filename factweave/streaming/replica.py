"""Streams over the append-only log: replicas of the current view, and windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import SCHEMA


def log_stream(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


class Replica:
    """A read replica: for each fact the newest transaction and whether it retracts, kept as tables.

    A batch touches only the facts it names: it is reduced to one row each and appended as a run, so
    no batch rewrites the replica; readers take the maximum over runs, and compact() merges them."""

    KEYS = ("e", "a", "v_long", "v_double", "v_str", "v_bool", "v_bin")

    def __init__(self, spark: SparkSession, log_path: str, path: str):
        self.spark, self.log_path, self.path = spark, log_path, path

    @staticmethod
    def reduced(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*Replica.KEYS).agg(F.max("m").alias("m"))

    def follow(self, checkpoint: str, files_per_trigger: int | None = None) -> StreamingQuery:
        """Take in what the log has, and stop."""
        mark = F.shiftleft("t", 1).bitwiseOR(F.when(F.col("added"), 0).otherwise(1).cast("long"))
        stream = log_stream(self.spark, self.log_path, files_per_trigger=files_per_trigger).withColumn("m", mark)

        def take(batch: DataFrame, number: int) -> None:
            # the batch's own folder: a batch that runs again replaces what it wrote
            self.reduced(batch).write.mode("overwrite").parquet(f"{self.path}/run={number}")

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def current(self) -> DataFrame:
        runs = self.reduced(self.spark.read.parquet(self.path))
        return runs.where(F.col("m").bitwiseAND(F.lit(1)) == 0).withColumn("t", F.shiftright("m", 1)).drop("m")

    def compact(self, to: str) -> Replica:
        self.reduced(self.spark.read.parquet(self.path)).write.parquet(f"{to}/run=-1")
        return Replica(self.spark, self.log_path, to)


class Windows:
    """Windows over event time that a stream keeps up to date, as tables.

    A batch appends the windows it changed as a run of its own, which a batch that runs again
    replaces; readers take each window's newest run. Rows later than the watermark are dropped."""

    def __init__(self, spark: SparkSession, path: str, ts: str, length: str, late: str, by: list[str], slide: str | None = None, **aggregates: Column):
        self.spark, self.path, self.by = spark, path, by
        self.over = lambda events: windowed(events, ts, length, late, by, slide, **aggregates)

    def follow(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in what the stream has, and stop."""
        out = self.over(events)
        out = out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *out.columns[1:])

        def take(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.path}/run={number}")

        return out.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def current(self) -> DataFrame:
        runs = self.spark.read.parquet(self.path)
        keys, rest = ["start", "end", *self.by], [c for c in runs.columns if c not in ("start", "end", "run", *self.by)]
        newest = runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), "run").alias("row"))
        return newest.select(*keys, "row.*")


def changes(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, at, before, now) of each row whose value differs from its key's last one, before being
    null for the first. The last value of a key is the state; rows of a batch are taken in order."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = dict(stream.dtypes)

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        before = rows[value].shift(1)
        before.iloc[0] = last
        changed = before.isna() | (before != rows[value])
        state.update((rows[value].iloc[-1],))
        yield pd.DataFrame({"key": name[0], "at": rows[order][changed], "before": before[changed].astype(object).where(before[changed].notna(), None), "now": rows[value][changed]})

    out = f"key {kinds[key]}, at {kinds[order]}, before {kinds[value]}, now {kinds[value]}"
    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(step, out, f"last {kinds[value]}", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, ts: str, length: str, late: str, by: list[str], slide: str | None = None, **aggregates) -> DataFrame:
    """Tumbling or sliding windows with a watermark; works on streams and tables alike."""
    at = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(at.alias("window"), *by).agg(*[c.alias(n) for n, c in aggregates.items()])


def session_windows(events: DataFrame, ts: str, gap: str, late: str, by: list[str], **aggregates) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("window"), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
