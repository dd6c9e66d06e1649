"""Views of the fact log: current, as of a transaction, and the whole history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    as_of: int | None = None
    history: bool = False


def facts(log: DataFrame, view: View, keys: tuple[str, ...] = ("e", "v"), retracted: bool = True) -> DataFrame:
    """log (keys, t, added) seen through view.

    Of each fact the newest row counts, and a retraction wins a tie: both follow from one maximum of
    t and a retraction bit, a plain long that is aggregated by hashing. Filters on the keys pass
    through the aggregate to the scan. retracted=False: no fact of this log was ever retracted or
    asserted twice, so the aggregate is skipped."""
    if view.as_of is not None:
        log = log.where(F.col("t") <= F.lit(view.as_of))
    if view.history:
        return log.select(*keys, "t", "added").distinct()
    if not retracted:
        return log.select(*keys, "t", F.lit(True).alias("added"))
    bit = F.shiftleft("t", 1).bitwiseOR(F.when(F.col("added"), F.lit(0)).otherwise(F.lit(1)).cast("long"))
    newest = log.groupBy(*keys).agg(F.max(bit).alias("m")).where(F.col("m").bitwiseAND(F.lit(1)) == 0)
    return newest.select(*keys, F.shiftright("m", 1).alias("t"), F.lit(True).alias("added"))


def resolve_instant(instants: DataFrame, at: int) -> int | None:
    """The newest transaction of (e, v) whose instant v, in microseconds, is at most at."""
    row = instants.where(F.col("v") <= F.lit(at)).agg(F.max_by("e", F.struct("v", "e")).alias("e")).first()
    return row["e"]
