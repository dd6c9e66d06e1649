"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words, as a Java regular expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set, else one of
    the warehouse, which on a cluster mustn't be a folder of this machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        if folder.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of this machine alone")
    return folder.rstrip("/")


SCOPES: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are deleted at the end; nothing that reads them may be left by then."""
    SCOPES.append([])
    try:
        yield
    finally:
        for path in SCOPES.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: its lineage ends there,
    so a lost executor costs only the tasks it ran."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if SCOPES:
        SCOPES[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of taken is called so."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def id_remainder(doc_id: str, parts: int) -> Column:
    """crc32(doc_id as text) mod parts."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


# ---- bounded memory in Python workers -------------------------------------------------------------

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Have Spark cut Arrow batches at `size` bytes where the session has Spark's own default (64 MB):
    both the JVM and the worker hold a batch, once for each running task."""
    if spark.conf.get(BATCH_BYTES) in ("64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(BATCH_BYTES, size)


def slices(batch: pa.RecordBatch, text: int, rows: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """batch in order, in parts of at most `rows` rows and `most` bytes of its column `text`; a longer
    text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, upto[at] - sizes[at] + most, "right"))
        end = min(max(end, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def tidy() -> None:
    """Give freed memory back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
