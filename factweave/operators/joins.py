"""Joins on values that several rows of both sides hold: the result grows with the square of a value's rows."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a join may make where Spark deals it, and about those that a task makes otherwise.
TASK = 1 << 22
#: Rows of a value, of each side, that meet in one block.
BLOCK = 1 << 10
#: More tasks than the driver can keep account of; from then on they grow.
MOST_TASKS = 100_000


def common(a: str, b: str) -> str:
    """The type in which values of types a and b are compared."""
    numbers = ["smallint", "int", "bigint", "float", "double"]
    if a == b:
        return a
    if not {a, b} <= set(numbers):
        return "string"
    return "double" if {a, b} & {"float", "double"} else max(a, b, key=numbers.index)


def value_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """left and right, whose columns differ in name, joined where the columns of each pair are equal.

    A value of n rows on the left and m on the right makes n * m rows, however few values there are.
    Both sides are counted first. Where all make more than TASK rows, the join is dealt: a value's rows
    are cut into blocks of about BLOCK, each pair of blocks meets once, and there is a task for about
    every TASK rows of the result. A row is sent to as many blocks as the other side has of its value,
    so what is shuffled is the input and about a BLOCK-th of the result."""
    types = [common(dict(left.dtypes)[a], dict(right.dtypes)[b]) for a, b in on]
    sides = []
    for side, df, names in (("l", left, [a for a, _ in on]), ("r", right, [b for _, b in on])):
        keys = [F.col(f"`{c}`").cast(t) if dict(df.dtypes)[c] != t else F.col(f"`{c}`") for c, t in zip(names, types, strict=True)]
        sides.append(df.where(reduce(operator.and_, [k.isNotNull() for k in keys])).withColumns({f"~{side}{i}": k for i, k in enumerate(keys)}))
    keys = [[f"~{side}{i}" for i in range(len(on))] for side in "lr"]
    out = [*left.columns, *right.columns]
    if left.isStreaming or right.isStreaming:
        return met(*sides, keys).select(*map(quoted, out))
    total, heavy = counted(sides, keys)
    if total > TASK:
        tasks = min(MOST_TASKS, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), round(total / TASK)))
        if heavy:
            blocks = left.sparkSession.createDataFrame([(h, *b) for h, b in heavy.items()], "`~h` long, `~left` long, `~right` long")
            sides = [dealt(df, k, blocks, f"~{side}") for side, df, k in zip("lr", sides, keys, strict=True)]
            keys = [[*k, f"~{side}left", f"~{side}right"] for side, k in zip("lr", keys, strict=True)]
        sides = [df.repartition(tasks, *k) for df, k in zip(sides, keys, strict=True)]
    return met(*sides, keys).select(*map(quoted, out))


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def met(left: DataFrame, right: DataFrame, keys: list[list[str]]) -> DataFrame:
    return left.join(right, reduce(operator.and_, [quoted(a) == quoted(b) for a, b in zip(*keys, strict=True)]))


def counted(sides: list[DataFrame], keys: list[list[str]]) -> tuple[float, dict[int, tuple[int, int]]]:
    """How many rows the join makes, and {hash of a value: blocks on the left, on the right} of the values
    that make more than a pair of blocks. Values of one hash count as one: both sides cut them alike.
    Each such value makes a million rows, so they are few where the result can be made at all."""
    rows = [df.select(F.xxhash64(*k).alias("h"), F.lit(int(i == 0)).alias("n"), F.lit(int(i == 1)).alias("m")) for i, (df, k) in enumerate(zip(sides, keys, strict=True))]
    made = F.col("n").cast("double") * F.col("m")
    found = rows[0].unionAll(rows[1]).groupBy("h").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    total, heavy = found.agg(F.sum(made), F.collect_list(F.when(made > BLOCK * BLOCK, F.struct("h", "n", "m")))).first()
    return total or 0, {r["h"]: (-(-r["n"] // BLOCK), -(-r["m"] // BLOCK)) for r in heavy}


def dealt(df: DataFrame, keys: list[str], blocks: DataFrame, side: str) -> DataFrame:
    """df with the pair of blocks that each row goes to: one of its own side's, by hash, and each of the
    other's. Equal rows are told apart by their place among them, which a task run again gives alike."""
    own, other = ("left", "right") if side == "~l" else ("right", "left")
    df = df.withColumns({"~h": F.xxhash64(*keys), "~row": F.xxhash64(*[quoted(c) for c in df.columns])})
    place = F.row_number().over(Window.partitionBy("~row").orderBy("~row"))
    df = df.withColumn("~place", place).join(F.broadcast(blocks), "~h", "left")
    df = df.withColumn(f"{side}{own}", F.pmod(F.xxhash64("~row", "~place"), F.coalesce(f"~{own}", F.lit(1))))
    df = df.withColumn(f"{side}{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"~{other}", F.lit(1)) - 1)))
    return df.drop("~h", "~row", "~place", "~left", "~right")
