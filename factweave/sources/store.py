"""The fact log: append-only Parquet segments, a small table of commits, and a buffer on the driver.

Facts written one at a time collect in the buffer, are visible at once and become files on commit;
facts written in bulk are DataFrames and never pass through the driver. A transaction's bulk facts are
staged and written together when it ends. An append writes a segment (partitioned by attribute) and
then one row of the commit table that names it: readers only know segments of committed rows, so a
write that fails half-way is never seen. The commits also carry the id counters and the attributes
held, so opening a log reads no facts but those of the schema.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import SHIFT
from ..functions.values import COLUMN, COLUMNS, ValueType
from .catalog import Attribute

VALUES = tuple(COLUMNS)
SCHEMA = "e long, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items()) + ", t long, added boolean, a int"
COMMITS = "seq long, segment string, newest_t long, sequences map<string, long>, attributes array<int>, counts map<string, long>, replaces array<string>"
#: The same as SCHEMA.
ARROW = pa.schema([("e", pa.int64()), *[(c, {"long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for c, t in COLUMNS.items()], ("t", pa.int64()), ("added", pa.bool_()), ("a", pa.int32())])
#: Facts that the index of recent writes holds at most.
INDEXED = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of the warehouse where that is unset; on a cluster the
    warehouse has to be shared as well."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        local = spark.sparkContext.master.startswith("local")
        if folder.startswith(("file:", "/")) and not local:
            raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of this machine alone")
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Index:
    """The current values of attributes all of whose facts this session has written one at a time:
    {attribute: {entity: values}}, and the holders of unique values. Lookups in them need no job.
    Beyond `most` facts it is given up and lookups read the log."""

    def __init__(self, most: int = INDEXED):
        self.most, self.facts = most, 0
        self.values: dict[int, dict[int, list]] = {}
        self.holders: dict[int, dict[Any, int]] = {}

    def covers(self, aid: int) -> bool:
        return aid in self.values

    def start(self, aid: int) -> None:
        if self.facts < self.most:
            self.values[aid], self.holders[aid] = {}, {}

    def forget(self, aid: int) -> None:
        if aid in self.values:
            self.facts -= sum(map(len, self.values.pop(aid).values()))
            del self.holders[aid]

    def put(self, e: int, a: Attribute, value: Any, added: bool) -> None:
        if a.aid not in self.values:
            return
        now, holders = self.values[a.aid].setdefault(e, []), self.holders[a.aid]
        if added and value not in now:
            now.append(value)
            self.facts += 1
            if a.unique:
                holders[value] = e
        elif not added and value in now:
            now.remove(value)
            self.facts -= 1
            if holders.get(value) == e:
                del holders[value]
        if self.facts > self.most:
            self.values, self.holders, self.facts = {}, {}, self.most


class FactStore:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
        self.buffer: dict[tuple, tuple] = {}
        self.local: DataFrame | None = None  # the buffer, until it changes
        self.staged: list[DataFrame] = []
        self.attached: dict[int, Callable[[], DataFrame]] = {}
        self.homes: dict[int, int | None] = {}
        self.held: set[int] = set()
        self.index = Index()
        self.segments: list[str] = []
        self.commits = 0
        self.sequences: dict[int, int] = {}
        self.newest = 0
        self.counts: dict[int, int] = {}
        self.files: DataFrame | None = None
        if path:
            self.open()

    # -- commits
    def committed(self) -> list:
        try:
            return sorted(self.spark.read.schema(COMMITS).json(f"{self.path}/_commits").collect(), key=lambda r: r["seq"])
        except AnalysisException:
            return []

    def open(self) -> None:
        """Segments, counters and attributes from the commits of an existing log."""
        self.segments, self.commits, self.held, self.sequences, self.newest, self.counts = [], 0, set(), {}, 0, {}
        for r in self.committed():
            gone = set(r["replaces"] or [])
            self.segments = [s for s in self.segments if s not in gone] + [r["segment"]]
            self.count({int(a): n for a, n in r["counts"].items()}, whole=bool(gone))
            self.commits = r["seq"] + 1
            self.held |= set(r["attributes"])
            self.newest = max(self.newest, r["newest_t"])
            for p, n in r["sequences"].items():
                self.sequences[int(p)] = max(self.sequences.get(int(p), 0), n)
        self.refresh()

    def refresh(self) -> None:
        self.files = self.read(self.segments) if self.segments else None

    def read(self, segments: list[str]) -> DataFrame:
        """The facts of some segments; each is a partition folder of the log."""
        reader = self.spark.read.schema(f"{SCHEMA}, seg string").option("basePath", self.path)
        return reader.parquet(*[f"{self.path}/seg={s}" for s in segments]).drop("seg")

    def append(self, rows: DataFrame, replaces: list[str] | None = None, held: set[int] | None = None, **layout: Any) -> None:
        """Write rows of SCHEMA as one segment, then the commit that names it."""
        segment = f"{self.commits:08}-{uuid.uuid4().hex[:12]}"
        writer = rows.write.partitionBy("a")
        for name, value in layout.items():
            writer = writer.option(name, value)
        writer.parquet(f"{self.path}/seg={segment}")
        new = self.read([segment])
        # a row for each attribute and id partition; only e and t are read
        tops = new.groupBy("a", F.shiftright("e", SHIFT).alias("p")).agg(F.max("e").alias("e"), F.max("t").alias("t"), F.count(F.lit(1)).alias("n")).collect()
        sequences, counts = {}, {}
        for r in tops:
            sequences[str(r["p"])] = max(sequences.get(str(r["p"]), 0), (r["e"] & ((1 << SHIFT) - 1)) + 1)
            counts[str(r["a"])] = counts.get(str(r["a"]), 0) + r["n"]
        attributes = sorted(self.held if held is None else held)
        newest = max((r["t"] or 0 for r in tops), default=0)
        row = (self.commits, segment, newest, sequences, attributes, counts, replaces or [])
        self.spark.createDataFrame([row], COMMITS).coalesce(1).write.mode("append").json(f"{self.path}/_commits")
        self.segments = [s for s in self.segments if s not in set(replaces or [])] + [segment]
        self.commits, self.newest = self.commits + 1, max(self.newest, newest)
        self.count({int(a): n for a, n in counts.items()}, whole=bool(replaces))
        self.refresh()

    def count(self, counts: dict[int, int], whole: bool) -> None:
        self.counts = counts if whole else {a: self.counts.get(a, 0) + counts.get(a, 0) for a in self.counts | counts}

    def estimate(self, a: Attribute) -> int:
        """How many facts an attribute has, from the commits and the buffer; at least 1."""
        return max(1, self.counts.get(a.aid, 0) + sum(k[1] == a.aid for k in self.buffer))

    # -- writing
    def put(self, e: int, a: Attribute, value: Any, t: int, added: bool) -> None:
        """Buffer a fact. In one transaction the last operation on it counts."""
        if a.aid not in self.held:
            self.index.start(a.aid)
        self.held.add(a.aid)
        self.local = None
        self.buffer.pop((e, a.aid, t, value), None)
        self.buffer[e, a.aid, t, value] = (e, *[value if c == COLUMN[a.type] else None for c in VALUES], t, added, a.aid)
        self.index.put(e, a, value, added)

    def stage(self, a: Attribute, rows: DataFrame) -> None:
        """Rows (e, v, t, added) of one attribute, v in its native type, for the segment that the
        transaction writes when it ends."""
        value = F.unix_micros("v") if a.type == ValueType.INSTANT else F.col("v")
        self.staged.append(rows.select("e", *[(value if c == COLUMN[a.type] else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()], "t", "added", F.lit(a.aid).alias("a")))
        self.index.forget(a.aid)
        self.held.add(a.aid)

    def publish(self, t: int) -> None:
        """Write what transaction t has staged, together with its buffered facts, in one append."""
        if self.staged:
            own = {k: r for k, r in self.buffer.items() if k[2] == t}
            self.append(reduce(DataFrame.unionByName, [*self.staged, self.spark.createDataFrame([*own.values()], SCHEMA)] if own else self.staged))
            self.staged, self.local = [], None
            for k in own:
                del self.buffer[k]

    def undo(self, t: int, held: set[int]) -> None:
        """Drop what transaction t has buffered and staged. held: the attributes before it."""
        self.staged, self.local = [], None
        for k in [k for k in reversed(self.buffer) if k[2] == t]:
            self.index.forget(k[1])
            del self.buffer[k]
        self.held = held

    def commit(self) -> int:
        n = len(self.buffer)
        if n:
            self.append(self.buffered())
            self.buffer, self.local = {}, None
        return n

    def attach(self, a: Attribute, frame: Callable[[], DataFrame], partition: int | None = None) -> None:
        """Facts (e, v, t, added) of an attribute that another table holds, their entities all of one
        id partition if it is given."""
        self.attached[a.aid] = frame
        self.homes[a.aid] = partition
        self.index.forget(a.aid)
        self.held.add(a.aid)

    # -- reading
    def buffered(self) -> DataFrame:
        """The buffer as a local relation, which Catalyst filters without a job."""
        if self.local is None:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.buffer.values(), strict=True), ARROW, strict=True)] if self.buffer else [pa.array([], f.type) for f in ARROW]
            self.local = self.spark.createDataFrame(pa.Table.from_arrays(columns, schema=ARROW), SCHEMA)
        return self.local

    def log(self) -> DataFrame:
        parts = [self.files] if self.files is not None else []
        parts += self.staged
        if self.buffer or not parts:
            parts.append(self.buffered())
        return reduce(DataFrame.unionByName, parts)

    def holds(self, a: Attribute) -> bool:
        return a.aid in self.held

    def attribute(self, a: Attribute) -> DataFrame:
        """(e, v, t, added) of one attribute: one partition and one value column of the log."""
        value = F.col(COLUMN[a.type])
        if a.type == ValueType.INSTANT:
            value = F.timestamp_micros(value)
        extra = self.attached.get(a.aid)
        if extra is not None and self.files is None and not self.staged and not any(k[1] == a.aid for k in self.buffer):
            return extra()
        own = self.log().where(F.col("a") == a.aid).select("e", value.alias("v"), "t", "added")
        return own if extra is None else own.unionByName(extra())

    # -- maintenance
    def rewrite(self, rows_per_file: int) -> None:
        """All segments as one, sorted by attribute and entity; the old ones stay until sweep()."""
        if self.files is not None:
            # by attribute and entity, so that an attribute of any size is dealt to many tasks
            rows = self.files.repartitionByRange("a", "e").sortWithinPartitions("a", "e", "t")
            self.append(rows, replaces=list(self.segments), maxRecordsPerFile=rows_per_file)

    def folders(self) -> list[str]:
        """Segments that lie in the log's folder, committed or not."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.path).select(F.regexp_extract("path", r"/seg=([^/]+)/", 1).alias("s"))
        return sorted(r["s"] for r in listed.distinct().collect() if r["s"])

    def sweep(self, dry: bool = False) -> list[str]:
        """Segments that no commit needs any more, deleted unless dry."""
        if not self.segments:
            return []
        gone = [s for s in self.folders() if s not in set(self.segments)]
        if not dry:
            for s in gone:
                remove(self.spark, f"{self.path}/seg={s}")
        return gone
