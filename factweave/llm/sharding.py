"""Contiguous shards with the smallest largest size.

Rows of equal text form an atomic group. Groups stand in the order of their SHA-256 digests; the
shards are contiguous runs of that order, so a row's shard follows from comparing its digest with the
cut digests: no join brings groups and rows together, and a text that a third of all rows share costs
no task more than others. The smallest feasible capacity is found by binary search with a greedy
check, as in the classic painter's partition problem.

The search needs cumulative sizes of groups, of which there may be billions. It runs on a bounded
number of candidate cuts, the last group of each of at most `limit` equal intervals, which gives one
capacity that surely suffices and one that surely doesn't; only groups between the cuts of the two
can matter, and the next round divides just those intervals. It ends when all that matter fit the
limit, and is exact.

A group larger than an equal share of what is left would decide the capacity alone and leave the
other shards uneven, so each such group gets a shard of its own first and the rest share the rest.

Defined results: a null text has no bytes and forms a group of its own, apart from empty texts; an
empty table gives no rows; repeated rows count as often as they occur; slots follow (salt, doc_id),
and rows that agree in both in any order; other columns are ignored. With fewer groups than shards,
some shards stay empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_length, save

SHARDS = 24
#: Candidate cuts, or prefix buckets, that the driver holds at most.
LIMIT = 50_000
#: At least so many for each pair of shards: a cut is uncertain by as many intervals as shards are before it.
LEAST_PER_CUT = 16
ROWS_PER_SALT = 20_000


def reach(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Greedy cuts: each is the largest end within capacity of the one before."""
    cuts, at = [], 0
    for _ in range(shards):
        k = int(np.searchsorted(ends, at + capacity, "right")) - 1
        if k < 0 or ends[k] <= at:
            break
        at = int(ends[k])
        cuts.append(at)
    return cuts


def reach_at_most(ends: np.ndarray, starts: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Upper bounds of the greedy cuts, if ends[i] is only the last end of the interval that begins
    behind starts[i], and other ends may lie in between."""
    cuts, at = [], 0
    for _ in range(shards):
        x = at + capacity
        k = int(np.searchsorted(ends, x, "right")) - 1
        best = int(ends[k]) if k >= 0 else 0
        if k + 1 < len(ends) and starts[k + 1] < x:
            best = x
        if best <= at:
            break
        at = best
        cuts.append(at)
    return cuts


def even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts within capacity, each as near as it can be to an equal share of what is left."""
    total, at, cuts = int(ends[-1]), 0, []
    backward = [total]  # the least end from which the last k shards suffice
    for _ in range(shards - 1):
        k = int(np.searchsorted(ends, backward[-1] - capacity, "left"))
        backward.append(int(ends[k]) if backward[-1] > capacity else 0)
    for left in range(shards, 1, -1):
        ideal = at + (total - at) / left
        low, high = max(at, backward[left - 1]), at + capacity
        k = int(np.searchsorted(ends, ideal, "right"))
        near = [int(e) for e in ends[max(0, k - 1) : k + 1] if low <= e <= high and e > at]
        greedy = int(ends[int(np.searchsorted(ends, high, "right")) - 1])
        at = min(near, key=lambda e: abs(e - ideal)) if near else greedy
        cuts.append(at)
    return [*dict.fromkeys(c for c in cuts if c < total), total]


def smallest(feasible, low: int, high: int) -> int:
    """The smallest capacity from low on that is feasible; high is."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def find_cuts(groups: DataFrame, total: int, largest: int, shards: int, limit: int = LIMIT) -> tuple[int, list[int]]:
    """The smallest capacity and its cuts. groups: a stored table with end, the size up to and with
    a group. The driver holds at most the larger of limit and LEAST_PER_CUT shards^2 candidates."""
    if not total:
        return 0, []
    # so many candidates that a round narrows the windows to a part of their width, whatever the groups
    limit = max(limit, LEAST_PER_CUT * shards * shards)
    windows, before = [(0, total)], None
    while True:
        inside = F.lit(False)
        for a, b in windows:
            inside |= (F.col("end") > a) & (F.col("end") <= b)
        here = groups.where(inside)
        wide = sum(b - a for a, b in windows)
        if before is not None and wide > before * 3 // 4:
            limit *= 2  # not met with LEAST_PER_CUT candidates and more, but the search has to end
        before = wide
        if wide <= limit or here.count() <= limit:
            exact = np.sort(np.array([r[0] for r in here.select("end").distinct().collect()], np.int64))
            ends = np.union1d(exact, [total])
            capacity = smallest(lambda c: (reach(ends, c, shards) or [0])[-1] == total, max(largest, -(-total // shards)), total)
            return capacity, even_cuts(ends, capacity, shards)
        width = max(1, wide // (limit // 2))
        bucket = F.lit(None).cast("long")
        for k, (a, b) in reversed([*enumerate(windows)]):
            bucket = F.when((F.col("end") > a) & (F.col("end") <= b), F.lit(k * 2 * limit) + F.expr(f"(end - 1 - {a}L) div {width}")).otherwise(bucket)
        found = here.groupBy(bucket.alias("bucket")).agg(F.max("end").alias("last"), F.min("end").alias("first")).collect()
        ends = np.array(sorted(r["last"] for r in found), np.int64)
        starts = np.array(sorted(r["first"] - 1 for r in found), np.int64)
        if ends[-1] != total:
            ends, starts = np.append(ends, total), np.append(starts, total - 1)
        floor = max(largest, -(-total // shards))
        high = smallest(lambda c: (reach(ends, c, shards) or [0])[-1] == total, floor, total)
        low = smallest(lambda c: (reach_at_most(ends, starts, c, shards) or [0])[-1] >= total, floor, high)
        least, most = reach(ends, low, shards), reach_at_most(ends, starts, high, shards)
        least += [least[-1] if least else 0] * (shards - len(least))  # the true cuts go on from there
        most += [total] * (shards - len(most))
        merged: list[tuple[int, int]] = []
        for a, b in sorted((x - 1, max(x, y)) for x, y in zip(least, most, strict=True)):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        windows = merged


def cumulative(groups: DataFrame, count: int) -> DataFrame:
    """groups (digest, bytes) with end, in the digests' order: a sum within the buckets of the
    digests' first bits, on top of the buckets' sums."""
    bits = max(4, min(15, (max(count, 1) // 1_000).bit_length()))
    bucket = F.shiftright(F.conv(F.substring("digest", 1, 4), 16, 10).cast("int"), 16 - bits)
    groups = groups.withColumn("bucket", bucket)
    sums = groups.groupBy("bucket").agg(F.sum("bytes").alias("bytes")).orderBy("bucket")
    before, total = [], 0
    for r in sums.collect():
        before.append((r["bucket"], total))
        total += r["bytes"]
    # 2^15 rows at most
    offsets = F.broadcast(groups.sparkSession.createDataFrame(before, "bucket int, offset long"))
    run = Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    placed = groups.withColumn("run", F.sum("bytes").over(run)).join(offsets, "bucket")
    return placed.withColumn("end", F.col("run") + F.col("offset")).drop("bucket", "run", "offset")


def slot_numbers(rows: DataFrame, shard: str, order: list[Column], count: int) -> DataFrame:
    """rows with slot, gapless from 0 in each shard: numbers within salted parts of a shard on top of
    the parts' counts. The parts' number grows with the rows, their size doesn't."""
    salts = max(8, -(-count // ROWS_PER_SALT))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = rows.groupBy(shard, "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy(shard).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(shard, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    run = Window.partitionBy(shard, "salt").orderBy(*order)
    numbered = rows.withColumn("rank", F.row_number().over(run))
    return numbered.join(counts, [shard, "salt"]).withColumn("slot", F.col("before") + F.col("rank") - 1).drop("salt", "before", "rank")


def shard_by_size(rows: DataFrame, shards: int = SHARDS, overhead: int = 8, limit: int = LIMIT) -> DataFrame:
    """Rows of (doc_id, text) with size, text_crc32, shard and slot. overhead: bytes a row takes
    besides its text."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    digest = F.when(F.col("text").isNull(), F.lit("-")).otherwise(F.sha2(text, 256))
    # the null group has a digest's form too, one that no text is likely to have
    digest = F.when(digest == "-", F.lit("0" * 64)).otherwise(digest)
    rows = save(rows.select("doc_id", (byte_length(text) + overhead).alias("size"), F.crc32(text).alias("text_crc32"), digest.alias("digest")), "sizes")
    groups = save(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total, count, n = groups.agg(F.sum("bytes"), F.count("*"), F.sum("n")).first()
    total, n = total or 0, n or 0
    alone: list[str] = []
    for digest_, size in groups.orderBy(F.desc("bytes"), "digest").limit(shards).select("digest", "bytes").collect():
        if len(alone) < shards - 1 and size * (shards - len(alone)) > total:
            alone.append(digest_)
            total -= size
    rest = groups.where(~F.col("digest").isin(alone)) if alone else groups
    largest = rest.agg(F.max("bytes")).first()[0] or 0
    placed = save(cumulative(rest, count), "ends")
    _, cuts = find_cuts(placed, total, largest, shards - len(alone), limit)
    last = sorted(r["digest"] for r in placed.where(F.col("end").isin(cuts[:-1])).select("digest").collect()) if len(cuts) > 1 else []
    shard = F.lit(len(alone))
    for k, d in enumerate(last):
        shard = F.when(F.col("digest") > d, F.lit(len(alone) + k + 1)).otherwise(shard)
    for k, d in enumerate(alone):
        shard = F.when(F.col("digest") == d, F.lit(k)).otherwise(shard)
    out = rows.withColumn("shard", shard.cast("int"))
    return slot_numbers(out, "shard", [F.col("doc_id"), F.col("digest")], n)
