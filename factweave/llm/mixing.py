"""Mixing sources to target weights by systematic sampling.

All documents of a source have the same expected number of copies, target / source size. In each
source the documents stand in the order (size class, salt, size, digest); the expected copies are
summed along it, one random offset is added, and a document is emitted once for each integer that
its interval crosses. Sorting by size classes spreads the choice evenly over sizes, so the words
taken come near the target: what is missed is about the size of one of the largest documents.

The rank of a document is its number in its (source, size class, salt) part on top of the parts'
counts; the number of salts grows with the rows, so no part and no task grows with a hot source.

Defined results: null and empty texts have size 0 and take no words; a source without words has
target 0 and is taken as it is (rate 1); null is a source of its own, ordered last; repeated rows
are documents of their own; an empty table gives no rows; other columns are ignored. The only random
values come from `seed`, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, save, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
ROWS_PER_PART = 2_000
SIZE_CLASSES = 8  # for each power of two


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """What each source gives: share of all sizes by weight, none above most times its size, the
    excess going to the others by weight until none is above."""
    left, free = share * sum(sizes), list(range(len(sizes)))
    out = [0.0] * len(sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while free:
        total = sum(w[i] for i in free)
        full = [i for i in free if left * w[i] / total > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in full]
    return out


def digest(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix:", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of documents
    (doc_id, text, source). keep: further columns to carry."""
    d = digest(seed)
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    rows = documents.select("doc_id", "source", size.alias("size"), d.alias("digest"), *keep)
    if "text" not in keep:
        rows = save(rows, "mix")  # without the texts
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    found = sorted(by_source.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    rates = targets([r["source_size"] for r in found], weights, share, most)
    spark = documents.sparkSession
    plan = spark.createDataFrame(
        [(r["source"], r["source_size"], t, t / r["source_size"] if r["source_size"] else 1.0) for r, t in zip(found, rates, strict=True)],
        "source string, source_size long, target double, rate double",
    )
    salts = max(16, max((r["n"] for r in found), default=0) // (ROWS_PER_PART * 16))
    salt = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(salts)).cast("int")
    grade = F.floor(F.log2(F.col("size") + F.lit(1.0)) * SIZE_CLASSES).cast("int")
    rows = rows.withColumn("grade", grade).withColumn("salt", salt)
    part = ["source", "grade", "salt"]
    counts = rows.groupBy(*part).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("grade", "salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    counts = counts.select(*(F.col(c).alias(f"{c}_") for c in part), "before")
    same = F.lit(True)
    for c in part:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    rank = F.row_number().over(Window.partitionBy(*part).orderBy("size", "digest", "doc_id", *keep))
    rows = rows.withColumn("rank", rank).join(counts, same).drop(*(f"{c}_" for c in part))
    # one row a source: the driver has just counted them
    rows = rows.join(F.broadcast(plan.withColumnRenamed("source", "source_")) if len(found) <= 10_000 else plan.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "offset:"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    place = F.col("before") + F.col("rank")
    copies = F.floor(place * F.col("rate") + offset) - F.floor((place - 1) * F.col("rate") + offset)
    rows = rows.withColumn("copies", copies.cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select("doc_id", "source", "size", *keep, "source_size", "target", "copies", "taken")
