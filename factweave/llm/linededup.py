"""Removing repeated passages: overlapping windows of three consecutive lines.

The windows' hashes are grouped over the whole corpus; of each window that occurs more than once the
occurrence with the smallest (doc_id, text hash, position) stays and the lines that later ones cover
are removed, overlapping and adjacent ones together. Built-in functions only; what is shuffled for
the search are hashes and positions, never texts. A window's first occurrence is found by an aggregate
that is reduced before the shuffle; the occurrences of one window then meet its first in a join, which
adaptive execution splits where one window has very many.

Defined results: texts are split at line feeds; texts of fewer than three lines have no windows and
stay; windows of three blank lines don't count; a null text stays null; rows that agree in doc_id
and text count as one document and share its result; a null doc_id is the smallest; a text whose
lines all go becomes empty. Further columns of any name stay; those named as the counts are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, save

WINDOW = 3


def windows(lines: Column, size: int = WINDOW) -> Column:
    """Structs of position and two 64-bit hashes for each run of size lines that aren't all blank."""
    n = F.size(lines)
    get = lambda i: [F.get(lines, i + j) for j in range(size)]
    starts = F.filter(F.sequence(F.lit(0), n - size), lambda i: F.trim(F.concat_ws("", *get(i))) != "")
    made = F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(*get(i)).alias("h1"), F.xxhash64(F.lit(size), *get(i)).alias("h2")))
    return F.when(n >= size, made)


def later_windows(documents: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, text_hash and the starts of the windows that occur earlier in the corpus."""
    found = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.explode(let(F.split("text", "\n"), lambda lines: windows(lines, size))).alias("w"),
    ).select("doc_id", "text_hash", "w.*")
    found = save(found, "windows")
    place = F.struct("doc_id", "text_hash", "at")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last"))
    repeated = found.join(first.select("h1", "h2", "first"), ["h1", "h2"]).where(place > F.col("first"))
    return repeated.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("starts"))


def without_repeated_lines(documents: DataFrame, size: int = WINDOW, counts: tuple[str, str] = ("n_lines", "removed_lines")) -> DataFrame:
    """documents with the repeated lines gone from text, and columns named by counts: how many lines a
    text had and how many are gone."""
    id_, hash_, starts = fresh([*documents.columns, *counts], "doc_id_", "text_hash_", "starts_")
    later = later_windows(documents, size).toDF(id_, hash_, starts)
    rows = documents.join(later, (F.col("doc_id").cast("long").eqNullSafe(F.col(id_))) & (F.xxhash64("text") == F.col(hash_)), "left")
    lines = F.split("text", "\n")
    covered = F.flatten(F.transform(starts, lambda a: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: a + j)))
    left_over = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    kept = let(lines, lambda ls: F.array_join(F.transform(left_over, lambda i: F.get(ls, i)), "\n"))
    rows = rows.withColumn(counts[0], F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)))
    rows = rows.withColumn(counts[1], F.when(F.col(starts).isNull(), 0).otherwise(F.size(F.array_distinct(covered))))
    return rows.withColumn("text", F.when(F.col(starts).isNull(), F.col("text")).otherwise(kept)).drop(id_, hash_, starts)
