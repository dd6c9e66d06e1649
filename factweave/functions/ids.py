"""Entity ids: the partition in the bits from 44 up, a sequence number below."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 44
MASK = (1 << SHIFT) - 1
DB, TX, USER, FIRST_CUSTOM = 0, 3, 4, 64
FIRST_DB_SEQ = 100


def make_eid(partition: int, seq: int) -> int:
    return partition << SHIFT | seq


def partition_of(eid: int) -> int:
    return eid >> SHIFT


def seq_of(eid: int) -> int:
    return eid & MASK


def eid_column(partition: int, key: Column) -> Column:
    """Ids of a bulk load: arithmetic, without coordination."""
    return F.lit(partition << SHIFT).bitwiseOR(key.cast("long"))
