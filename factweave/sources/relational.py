"""Existing tables as facts: eid from the key, one attribute for each mapped column, nothing rewritten."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import SHIFT, eid_column


@dataclass(eq=False)
class RelationalSource:
    """frame makes the table; key is its key column, or keyed makes one where it has none (only
    applied if a query needs entity ids). columns: attribute name -> expression."""

    frame: Callable[[], DataFrame]
    partition: int
    columns: dict[str, Column]
    key: str | None = None
    keyed: Callable[[DataFrame], DataFrame] | None = None
    load_tx: int = 0

    def table(self, ids: bool) -> DataFrame:
        df = self.frame()
        return self.keyed(df) if ids and self.keyed else df

    def key_column(self) -> Column:
        return F.col(self.key or "_key")

    def eid(self) -> Column:
        return eid_column(self.partition, self.key_column())

    def compare_key(self, op: Callable[[Column, Column], Column], eid: int) -> Column:
        """op(eid, constant) as a comparison of the plain key, which the scan can use."""
        return op(self.key_column(), F.lit(eid - (self.partition << SHIFT)))
