"""Tables to facts and back, and delimited files in zip archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import SHIFT, USER
from ..functions.values import ValueType


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """Headerless delimited text with all columns as strings."""
    return spark.read.csv(path, sep=sep, encoding=encoding, quote='"', schema=", ".join(f"`{c}` string" for c in columns))


def read_zipped(spark: SparkSession, path: str, columns: list[str], sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """Headerless delimited text in the members of zip archives, one archive a task, in batches."""
    import csv

    import pyarrow as pa

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[list[str]]) -> pa.RecordBatch:
            full = [[*r[: len(columns)], *[None] * (len(columns) - len(r))] for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*full, strict=True)], names=columns)

        for b in batches:
            for content in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        held: list[list[str]] = []
                        for row in csv.reader(io.TextIOWrapper(z.open(name), encoding=encoding, newline=""), delimiter=sep):
                            held.append(row)
                            if len(held) == 10_000:
                                yield batch(held)
                                held = []
                        if held:
                            yield batch(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, ", ".join(f"`{c}` string" for c in columns))


def shred(df: DataFrame, eid: str, columns: dict[str, str], skip: tuple[str, ...] = ("", "00000000"), lists: tuple[str, ...] = (), sep: str = ",") -> DataFrame:
    """Rows of df as facts (e, a, v) of string values: one for each named column that isn't null or
    in skip; those in lists are split into several."""
    pairs = ", ".join(f"'{a}', cast(`{c}` as string)" for c, a in columns.items())
    facts = df.selectExpr(f"`{eid}` as e", f"stack({len(columns)}, {pairs}) as (a, v)")
    many = [columns[c] for c in lists]
    if many:
        values = F.when(F.col("a").isin(many), F.split("v", sep)).otherwise(F.array("v"))
        facts = facts.select("e", "a", F.trim(F.explode(values)).alias("v"))
    return facts.where(F.col("v").isNotNull() & ~F.trim("v").isin(list(skip)))


def resolved(df: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """df with codes replaced by the entities they name. references: for each column (code, e). Codes
    without an entity become null, so that they make no fact. Small code tables are broadcast, as
    adaptive execution finds them to be."""
    for i, (column, codes) in enumerate(references.items()):
        code, e = f"_code{i}", f"_entity{i}"
        names = codes.select(F.col("code").cast("string").alias(code), F.col("e").alias(e))
        df = df.join(names, F.col(column).cast("string") == F.col(code), "left").withColumn(column, F.col(e)).drop(code, e)
    return df


def load(session: Any, df: DataFrame, key: tuple[str, str], columns: dict[str, str], references: dict[str, str] | None = None, skip: tuple[str, ...] = ("", "00000000"), lists: tuple[str, ...] = (), sep: str = ",", partition: int = USER) -> DataFrame:
    """Merge the rows of a table into a session's facts, in one transaction.

    key: (column, unique attribute) tells entities apart; a row whose key exists adds to its entity,
    the others are new ones. columns: {column: attribute}; values that are null or in skip make no
    fact, and those in lists are split into several. references: {column: unique attribute}, where a
    column holds another entity's key. Returns the entities as (code, e)."""
    column, unique = key
    known = entities(session, unique)
    rows = df.where(F.col(column).isNotNull() & ~F.trim(F.col(column).cast("string")).isin(list(skip)))
    codes = rows.select(F.trim(F.col(column).cast("string")).alias("code")).distinct()
    first = session.sequences.get(partition, 1)
    fresh = codes.join(known, "code", "left_anti").withColumn("n", F.monotonically_increasing_id())
    top = F.lit((1 << SHIFT) - first - 1)
    number = F.when(F.col("n") < top, F.col("n") + F.lit(first)).otherwise(F.raise_error(F.lit("no ids left")).cast("long"))
    fresh = session.pinned(fresh.select(F.lit(partition << SHIFT).bitwiseOR(number).alias("eid"), F.col("code").alias("code")), "load").select("code", F.col("eid").alias("e"))
    last = fresh.agg(F.max("e")).first()[0]
    if last is not None:
        session.sequences[partition] = (last & ((1 << SHIFT) - 1)) + 1
    every = known.join(codes, "code", "left_semi").unionByName(fresh)
    rows = rows.withColumn("code_", F.trim(F.col(column).cast("string"))).join(every.toDF("code_", "e_"), "code_").drop("code_")
    rows = resolved(rows, {c: entities(session, a) for c, a in (references or {}).items()})
    with session.transaction():
        session.save_many(unique, fresh.select("e", typed(session, unique, F.col("code")).alias("v")))
        for c, a in columns.items():
            if c in (references or {}):
                facts = rows.select(F.col("e_").alias("e"), F.col(c).alias("v"))
            else:
                text = F.trim(F.col(c).cast("string"))
                text = F.explode(F.split(text, sep)) if c in lists else text
                facts = rows.select(F.col("e_").alias("e"), text.alias("v")).where(~F.trim("v").isin(list(skip)))
                facts = facts.select("e", typed(session, a, F.trim("v")).alias("v"))
            session.save_many(a, facts)
    return every


def entities(session: Any, unique: str) -> DataFrame:
    """(code, e) of a unique attribute, code being its value as text."""
    a = session.catalog.get(unique)
    if a.source is None and not session.store.holds(a):
        return session.spark.createDataFrame([], "code string, e long")
    return session.current(unique).select(F.col("v").cast("string").alias("code"), "e")


def typed(session: Any, name: str, text: Column) -> Column:
    kind = session.catalog.get(name).type
    return text.cast({ValueType.LONG: "long", ValueType.REF: "long", ValueType.FLOAT: "double", ValueType.BOOLEAN: "boolean", ValueType.INSTANT: "timestamp"}.get(kind, "string"))


def pivoted(facts: DataFrame, names: list[str]) -> DataFrame:
    """Facts (e, a, v) of cardinality ONE as one row for each entity. The names are given, so no job
    has to find them."""
    return facts.groupBy("e").pivot("a", names).agg(F.first("v"))
