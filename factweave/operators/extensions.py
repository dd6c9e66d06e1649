"""What the dialect leaves to DataFrames: aggregates, windows, outer and anti joins, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])


def rolled_up(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    return df.rollup(*by).agg(*[c.alias(n) for n, c in aggregates.items()])


def cubed(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    return df.cube(*by).agg(*[c.alias(n) for n, c in aggregates.items()])


#: Rows that a task of a large sort holds, about.
SORTED = 1 << 19


def tasks_of(df: DataFrame, rows: int, most: int) -> int | None:
    """How many tasks take about so many rows, `most` or fewer each; None if adaptive execution may choose."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // most)) if rows > 4 * most else None


def in_order(df: DataFrame, rows: int, *order: str) -> DataFrame:
    """df, of about so many rows, sorted as a whole. Adaptive execution cuts what a sort reads by its
    compressed bytes, and sorted facts shrink to a few bytes a row: of a large df each task gets about
    SORTED rows instead, however many there are."""
    if n := tasks_of(df, rows, SORTED):
        df = df.repartitionByRange(n, *order)
    return df.orderBy(*order)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows: each task keeps n, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)


def top_in_group(df: DataFrame, n: int, by: list[str], *order: Column) -> DataFrame:
    """The first n rows of each group, with their rank; groups are cut to n before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def without(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def optional(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """A pattern that need not match: missing facts become nulls."""
    return df.join(other, on, "left")


def sessions(df: DataFrame, by: str, ts: str, gap_seconds: int) -> DataFrame:
    """df with session, the number of gaps of more than gap_seconds before a row of its group."""
    w = Window.partitionBy(by).orderBy(ts)
    starts = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) > gap_seconds * 1_000_000
    return df.withColumn("_new", F.coalesce(starts.cast("int"), F.lit(0))).withColumn("session", F.sum("_new").over(w)).drop("_new")


def having(candidates: list[DataFrame]) -> DataFrame:
    """Entities (e) that are in every frame: a facet filter by semi-joins."""
    out = candidates[0].select("e").distinct()
    for c in candidates[1:]:
        out = out.join(c.select("e"), "e", "left_semi")
    return out
