"""Raw key-value tables: a keyed log whose last write wins, deletions being tombstones.

Writes collect on the driver, are visible at once, and become a Parquet file on commit."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key binary, value binary, version long"


class KeyValues:
    def __init__(self, spark: SparkSession, path: str, stored: bool = False):
        """stored: path may hold pairs already."""
        self.spark, self.path, self.rows, self.files = spark, path, [], None
        self.version = 0
        if stored:
            self.open()

    def open(self) -> None:
        try:
            self.files = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            return
        self.version = self.files.agg(F.max("version")).first()[0] or 0

    def put(self, key: bytes, value: bytes | None) -> None:
        self.version += 1
        self.rows.append((bytearray(key), None if value is None else bytearray(value), self.version))

    def delete(self, key: bytes) -> None:
        self.put(key, None)

    def commit(self) -> int:
        n = len(self.rows)
        if n:
            self.spark.createDataFrame(self.rows, SCHEMA).write.mode("append").parquet(self.path)
            self.files, self.rows = self.spark.read.schema(SCHEMA).parquet(self.path), []
        return n

    def get(self, key: bytes) -> bytes | None:
        for k, value, _ in reversed(self.rows):
            if k == key:
                return None if value is None else bytes(value)
        row = self.scan(key, key + b"\0").first()
        return bytes(row["value"]) if row else None

    def scan(self, start: bytes = b"", end: bytes | None = None) -> DataFrame:
        log = self.spark.createDataFrame(self.rows, SCHEMA)
        return latest(log if self.files is None else self.files.unionByName(log), start, end)


def latest(log: DataFrame, start: bytes = b"", end: bytes | None = None) -> DataFrame:
    """The live pairs of a log (key, value, version) with start <= key < end, in order."""
    log = log.where(F.col("key") >= F.lit(start))
    if end is not None:
        log = log.where(F.col("key") < F.lit(end))
    live = log.groupBy("key").agg(F.max_by("value", "version").alias("value"))
    return live.where("value is not null").orderBy("key")
