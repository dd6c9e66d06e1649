"""Maintenance: status, flush and compaction."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F


def status(session: Any) -> dict[str, Any]:
    """Sizes, without a scan of the values."""
    store = session.store
    return {"buffered": len(store.buffer), "attributes": len(session.catalog.attributes), "partitions": len(session.catalog.partitions), "path": store.path, "files": len(store.files.inputFiles()) if store.files is not None else 0}


def tree(session: Any) -> Any:
    """Facts and distinct entities of each attribute in the log."""
    return session.store.log().groupBy("a").agg(F.count("*").alias("facts"), F.approx_count_distinct("e").alias("entities")).orderBy("a")


def estimate(session: Any, name: str) -> int:
    """How many facts an attribute has: of the log without a job, of a table by counting its rows."""
    a = session.catalog.get(name)
    return max(1, a.source.table(False).where(a.source.columns[a.name].isNotNull()).count()) if a.source is not None else session.store.estimate(a)


def flush(session: Any) -> int:
    return session.commit()


def compact(session: Any, rows_per_file: int = 5_000_000) -> int:
    """Rewrite the log's many small segments as one, sorted by attribute and entity; history is kept,
    and the old segments stay until gc. Returns the number of files."""
    session.commit()
    session.store.rewrite(rows_per_file)
    return len(session.store.files.inputFiles()) if session.store.files is not None else 0


def gc(session: Any, dry: bool = False) -> list[str]:
    """Delete the segments that no commit needs: those that compaction replaced, and those of writes
    that failed. Only while nobody else writes or reads an older state. dry: only name them."""
    return session.store.sweep(dry)
