"""Sessions: statements in, result records and DataFrames out."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ids import TX, USER, make_eid, partition_of, seq_of
from .functions.values import COLUMN, ValueType, coerce, literal, micros, rendered
from .operators.extensions import in_order
from .operators.views import View, facts, resolve_instant
from .plans import parser as sql
from .plans.binder import Binder
from .plans.compile import Compiler
from .plans.ir import Const, Query, Term, Var
from .sources.catalog import BOOTSTRAP, MANY, ONE, UNIQUE, Attribute, Catalog, SchemaError
from .sources.kv import KeyValues
from .sources.relational import RelationalSource
from .sources.store import FactStore, remove


#: Custom partitions are named by entities from here on, apart from those of attributes.
PARTITIONS = 1 << 32


class UniqueError(ValueError):
    pass


@dataclass
class SqlResult:
    """kind: SELECT, UPSERT, UPDATE, DELETE, SCHEMA or EXPLAIN. df holds rows that stay distributed."""

    kind: str
    columns: list[str]
    df: DataFrame | None = None
    values: list[tuple] = field(default_factory=list)

    def rows(self, limit: int | None = None) -> list[tuple]:
        if self.df is None:
            return self.values[:limit]
        return [tuple(r) for r in (self.df if limit is None else self.df.limit(limit)).collect()]

    @property
    def count(self) -> int:
        return len(self.values) if self.df is None else self.df.count()

    def batches(self, n: int = 100) -> Iterator[list[tuple]]:
        """Rows as they are pulled, n at a time."""
        held: list[tuple] = []
        for r in self.values if self.df is None else self.df.toLocalIterator():
            held.append(tuple(r))
            if len(held) == n:
                yield held
                held = []
        if held:
            yield held

    def __iter__(self) -> Iterator[tuple]:
        return (r for b in self.batches() for r in b)


class Session:
    def __init__(self, spark: SparkSession, path: str | None = None, view: View | None = None, clock: Callable[[], int] | None = None):
        self.spark, self.view = spark, view or View()
        self.clock = clock or (lambda: micros(dt.datetime.now(dt.UTC)))
        self.catalog, self.store = Catalog(), FactStore(spark, path)
        self.kv = KeyValues(spark, f"{self.store.path}/_kv", stored=path is not None)
        self.functions: dict[str, Callable[..., Column]] = {}
        self.scratch: list[str] = []  # tables written on the way
        self.sequences = {0: 100}
        self.tx: int | None = None
        self.coalesce = True
        if self.store.held:
            self.recover()
        else:
            with self.transaction():
                for name, aid in BOOTSTRAP.items():
                    self.store.put(aid, self.catalog.get("db.ident"), name, self.tx, True)

    # -- recovery
    def recover(self) -> None:
        """Catalog and counters from the facts of an existing log."""
        ident = {r["e"]: r["v"] for r in self.current("db.ident").collect()}
        value = {k: {r["e"]: r["v"] for r in self.current(f"db.{k}").collect()} if self.store.holds(self.catalog.get(f"db.{k}")) else {} for k in ("valueType", "cardinality", "unique")}
        for e, name in sorted(ident.items()):
            if e in value["valueType"]:
                a = self.catalog.put(Attribute(e, name, ValueType(value["valueType"][e]), value["cardinality"].get(e) == MANY, e in value["unique"], retracted=True))
                self.catalog.next_aid = max(self.catalog.next_aid, a.aid + 1)
            elif e >= PARTITIONS:
                self.catalog.partitions[name] = e - PARTITIONS
        self.sequences |= self.store.sequences
        self.sequences[TX] = max(self.sequences.get(TX, 1), seq_of(self.store.newest) + 1)

    # -- transactions and ids
    def alloc_entity(self, partition: int | str = USER) -> int:
        p = self.catalog.partitions[partition] if isinstance(partition, str) else partition
        n = self.sequences.get(p, 1)
        self.sequences[p] = n + 1
        return make_eid(p, n)

    @contextmanager
    def transaction(self) -> Iterator[int]:
        """One transaction for all that is written inside: its bulk facts become files together when it
        ends, and an error undoes it as a whole."""
        if self.tx is not None:
            yield self.tx
            return
        self.tx = t = self.alloc_entity(TX)
        held = set(self.store.held)
        retracted = {a.aid: a.retracted for a in self.catalog.attributes.values()}
        try:
            self.store.put(t, self.catalog.get("db.txInstant"), self.clock(), t, True)
            yield t
            self.store.publish(t)
        except BaseException:
            self.store.undo(t, held)
            for a in self.catalog.attributes.values():
                a.retracted = retracted.get(a.aid, a.retracted)
            raise
        finally:
            self.tx = None

    def clean(self, first: int = 0) -> None:
        """Delete the tables written on the way, from the first-th on. An open transaction still reads
        them, and so does what it has returned."""
        while self.tx is None and len(self.scratch) > first:
            remove(self.spark, self.scratch.pop())

    def commit(self) -> int:
        self.kv.commit()
        return self.store.commit()

    def register(self, name: str, function: Callable[..., Column]) -> None:
        """Let statements call a function of Columns, such as a pandas UDF, by a name."""
        if not name.isidentifier() or name.lower() in (*sql.SCALARS, *sql.AGGREGATES, "eid", "val"):
            raise ValueError(f"a function can't be called {name}")
        self.functions[name.lower()] = function

    # -- schema
    def declare_attribute(self, name: str, kind: str | ValueType, many: bool = False, unique: bool = False, indexed: bool = False, source: RelationalSource | None = None) -> Attribute:
        kind = kind if isinstance(kind, ValueType) else ValueType[kind.upper()]
        new = name not in self.catalog.attributes
        a, changed = self.catalog.declare(name, kind, many, unique, indexed, source)
        if changed:
            with self.transaction() as t:
                for attr, value in (("db.ident", a.name), ("db.valueType", int(kind)), ("db.cardinality", MANY if a.many else ONE), *([("db.unique", UNIQUE)] if a.unique else [])):
                    if new:  # nothing to replace, and the catalog keeps names apart
                        self.store.put(a.aid, self.catalog.get(attr), value, t, True)
                    else:
                        self.save(a.aid, attr, value)
        return a

    def declare_partition(self, name: str) -> int:
        new = name not in self.catalog.partitions
        p = self.catalog.partition(name)
        if new:
            with self.transaction() as t:
                self.store.put(PARTITIONS + p, self.catalog.get("db.ident"), name, t, True)
        return p

    def map_table(self, frame: DataFrame | Callable[[], DataFrame], partition: int, columns: dict[str, tuple[Column, ValueType]], key: str | None = None, keyed: Callable | None = None, unique: set[str] = frozenset()) -> None:
        """Make an existing table's columns attributes: {attribute: (expression, type)}."""
        source = RelationalSource(frame if callable(frame) else lambda: frame, partition, {n: c for n, (c, _) in columns.items()}, key, keyed)
        for name, (_, kind) in columns.items():
            self.declare_attribute(name, kind, unique=name in unique, source=source)

    def schema(self) -> DataFrame:
        return self.spark.createDataFrame(self.catalog.rows(), "aid int, name string, type string, cardinality string, unique boolean, indexed boolean")

    # -- reading
    def as_of(self, at: Any) -> Session:
        """This session's facts as of a transaction id, or an instant (ISO text, datetime, microseconds)."""
        out = object.__new__(Session)
        out.__dict__ |= self.__dict__
        if isinstance(at, int) and partition_of(at) == TX:
            tx: int | None = at
        else:
            a = self.catalog.get("db.txInstant")
            tx = resolve_instant(self.store.attribute(a).withColumn("v", F.unix_micros("v")), micros(at))
        out.view = View(as_of=-1 if tx is None else tx)
        return out

    def current(self, name: str) -> DataFrame:
        a = self.catalog.get(name)
        if a.source is not None:
            return a.source.table(True).select(a.source.eid().alias("e"), a.source.columns[a.name].alias("v"), F.lit(a.source.load_tx).alias("t"), F.lit(True).alias("added")).where("v is not null")
        return facts(self.store.attribute(a), self.view, retracted=a.retracted or self.view.as_of is not None)

    def values_of(self, e: int, a: Attribute) -> list[Any]:
        """The current values of an attribute of one entity, as the log stores them."""
        if a.source is None and not self.store.holds(a):
            return []
        if self.indexed(a):
            return list(self.store.index.values[a.aid].get(e, ()))
        df = self.current(a.name).where(F.col("e") == F.lit(e))
        return [r["v"] for r in df.select(F.unix_micros("v").alias("v") if a.type == ValueType.INSTANT else "v").collect()]

    def indexed(self, a: Attribute) -> bool:
        """Whether the index of recent writes answers for this session's view of an attribute."""
        return a.source is None and self.view == View() and self.store.index.covers(a.aid)

    def lookup_entity(self, name: str, value: Any) -> int | None:
        a = self.catalog.get(name)
        if not a.unique:
            raise SchemaError(f"eid() needs a unique attribute; {name} isn't")
        if value is None or a.source is None and not self.store.holds(a):
            return None
        if self.indexed(a):
            return self.store.index.holders[a.aid].get(coerce(value, a.type))
        row = self.current(name).where(F.col("v") == literal(value, a.type)).select("e").first()
        return row["e"] if row else None

    def lookup_value(self, e: int | None, name: str) -> Any:
        found = self.values_of(e, self.catalog.get(name)) if e is not None else []
        return found[0] if found else None

    def lookup(self, what: str, args: tuple) -> Any:
        return self.lookup_entity(*args) if what == "eid" else self.lookup_value(*args)

    def compiler(self, query: Query) -> Compiler:
        return Compiler(self, query, self.view, self.coalesce)

    # -- single writes
    def writable(self, name: str) -> Attribute:
        a = self.catalog.get(name)
        if a.source is not None:
            raise SchemaError(f"{name} belongs to a table and can't be written")
        return a

    def save(self, e: int, name: str, value: Any, new: bool = False) -> None:
        """Assert a fact; of cardinality ONE, retract the value it replaces. new: e has no facts yet."""
        a = self.writable(name)
        value = coerce(value, a.type)
        with self.transaction() as t:
            if a.unique:
                holder = self.lookup_entity(name, value)
                if holder is not None and holder != e:
                    raise UniqueError(f"{name} {value!r} belongs to {holder}")
            if not a.many and not new:
                for old in self.values_of(e, a):
                    if old != value:
                        a.retracted = True
                        self.store.put(e, a, bytes(old) if isinstance(old, bytearray) else old, t, False)
            # a fact asserted twice has two rows, and the view has to find the newest
            a.retracted = a.retracted or not new
            self.store.put(e, a, value, t, True)

    def retract(self, e: int, name: str, value: Any) -> None:
        if name not in self.catalog.attributes:
            return
        a = self.writable(name)
        with self.transaction() as t:
            a.retracted = True
            self.store.put(e, a, coerce(value, a.type), t, False)

    # -- bulk writes
    def save_many(self, name: str, rows: DataFrame) -> None:
        """Assert the facts (e, v) of a DataFrame in one transaction, by joins on the executors."""
        a = self.writable(name)
        with self.transaction() as t:
            new = rows.select(F.col("e").cast("long").alias("e"), F.col("v").alias("v")).where("e is not null and v is not null").distinct()
            known = self.store.holds(a)
            now = self.current(name).select("e", "v") if known else None
            if a.unique:
                whole = new if now is None else new.unionByName(now.join(new.select("e").distinct(), "e", "left_anti") if not a.many else now)
                twice = whole.groupBy("v").agg(F.count_distinct("e").alias("n")).where("n > 1").first()
                if twice:
                    raise UniqueError(f"{name} {twice['v']!r} would belong to several entities")
            if not a.many and new.groupBy("e").agg(F.count("*").alias("n")).where("n > 1").head(1):
                raise ValueError(f"{name} takes one value for each entity")
            out = new.select("e", "v", F.lit(t).alias("t"), F.lit(True).alias("added"))
            if now is not None and not a.many:
                gone = now.alias("n").join(new.alias("w"), (F.col("n.e") == F.col("w.e")) & (F.col("n.v") != F.col("w.v"))).select("n.e", "n.v", F.lit(t).alias("t"), F.lit(False).alias("added"))
                out = out.unionByName(gone)
            a.retracted = a.retracted or known
            self.store.stage(a, out)

    def retract_many(self, name: str, rows: DataFrame) -> None:
        a = self.writable(name)
        with self.transaction() as t:
            a.retracted = True
            self.store.stage(a, rows.select("e", "v").distinct().select("e", "v", F.lit(t).alias("t"), F.lit(False).alias("added")))

    # -- statements
    def sql(self, text: str, *params: Any, limit: int | None = None) -> SqlResult:
        return self.run(sql.parse(text), params, limit)

    def table(self, text: str, *params: Any) -> DataFrame:
        """The DataFrame of a SELECT."""
        return self.sql(text, *params).df

    def sql1(self, text: str, *params: Any) -> tuple | None:
        rows = self.sql(text, *params).rows(1)
        return rows[0] if rows else None

    def run(self, s: Any, params: tuple, limit: int | None = None) -> SqlResult:
        binder = Binder(self.catalog, params, self.lookup, self.functions)
        match s:
            case sql.Explain(statement):
                return SqlResult("EXPLAIN", ["plan"], values=[(self.explain(statement, params),)])
            case sql.Select():
                df = self.compiler(binder.select(s)).result()
                return SqlResult("SELECT", df.columns, df.limit(limit) if limit is not None else df)
            case sql.Upsert(clauses):
                return self.upsert(clauses, params)
            case sql.Update(alias, sets, where):
                return self.update(alias, sets, where, binder)
            case sql.Delete(where):
                return self.delete(where, binder)
            case sql.DeclareAttribute(name, kind, many, unique):
                a = self.declare_attribute(name, kind, many, unique)
                return SqlResult("SCHEMA", ["aid"], values=[(a.aid,)])
            case sql.DeclarePartition(name):
                return SqlResult("SCHEMA", ["partition"], values=[(self.declare_partition(name),)])
        raise sql.SqlError(f"no statement: {s!r}")

    def explain(self, s: Any, params: tuple = ()) -> str:
        """The patterns, the order of joins, and Spark's plan."""
        if isinstance(s, str):
            s = sql.parse(s)
        where = s if isinstance(s, sql.Select) else sql.Select([sql.Field("d1", "eid")], where=s.where, names=["eid"]) if isinstance(s, sql.Update | sql.Delete) else None
        if where is None:
            return f"{type(s).__name__}: {s}"
        query = Binder(self.catalog, params, self.lookup, self.functions).select(where)
        compiler = self.compiler(query)
        df = compiler.result()
        with contextlib.redirect_stdout(io.StringIO()) as text:
            df.explain("formatted")
        plan = text.getvalue()
        return "\n".join([*map(str, query.patterns), *compiler.plan, plan])

    def upsert(self, clauses: list[sql.Clause], params: tuple) -> SqlResult:
        with self.transaction() as t:
            ids: dict[str, int | None] = {"tx": t}
            fresh = set()
            binder = Binder(self.catalog, params, self.lookup, self.functions)
            for c in clauses:
                if c.alias == "tx":
                    continue
                if c.where is not None:
                    found = self.matches(c.alias, c.where, params).limit(1).collect()
                    ids[c.alias] = found[0][0] if found else None
                elif c.entity is not None:
                    ids[c.alias] = self.value(c.entity, ids, binder)
                else:
                    ids[c.alias] = self.alloc_entity()
                    fresh.add(c.alias)
            n, first = 0, None
            for c in clauses:
                e = ids[c.alias]
                if e is None:
                    continue  # a lookup that finds nothing leaves its clause out
                for name, node in c.sets:
                    value = self.value(node, ids, binder)
                    if value is not None:
                        # a name twice in one clause isn't new the second time
                        self.save(e, name, value, new=c.alias in fresh and [x for x, _ in c.sets].count(name) == 1)
                        n += 1
                if first is None and c.alias != "tx" and c.sets:
                    first = e
            return SqlResult("UPSERT", ["eid", "count"], values=[(first if first is not None else t, n)] if n else [])

    def value(self, node: Any, ids: dict[str, int | None], binder: Binder) -> Any:
        """A SET value: constants, aliases, and lookups in the facts."""
        if isinstance(node, sql.Field):
            if node.name == "eid" and node.alias in ids:
                return ids[node.alias]
            if ids.get(node.alias) is not None:
                return self.lookup_value(ids[node.alias], node.name)
            raise sql.SqlError(f"unknown alias {node.alias}")
        if isinstance(node, sql.Call):
            args = tuple(self.value(a, ids, binder) for a in node.args)
            return None if None in args else self.lookup(node.name, args)
        if isinstance(node, sql.Op):
            a = [self.value(x, ids, binder) for x in node.args]
            return -a[0] if node.op == "neg" else {"+": lambda: a[0] + a[1], "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1], "/": lambda: a[0] / a[1], "mod": lambda: int(a[0] - a[1] * int(a[0] / a[1]))}[node.op]()
        term = binder.term(node)
        return term.value if isinstance(term, Const) else None

    def matches(self, alias: str, where: Any, params: tuple, more: dict[str, Term] | None = None, binder: Binder | None = None) -> DataFrame:
        """Distinct entities of alias that where matches, as eid, and further terms."""
        binder = binder or Binder(self.catalog, params, self.lookup, self.functions)
        condition = binder.condition(where)
        eid = binder.field(sql.Field(alias, "eid"))
        query = binder.finish([("eid", eid), *(more or {}).items()], condition)
        return self.compiler(query).result().distinct()

    def changed(self, kind: str, t: int) -> SqlResult:
        """The entities that a transaction wrote, from the log."""
        rows = self.store.log().where((F.col("t") == F.lit(t)) & (F.col("e") != F.lit(t))).select(F.col("e").alias("eid")).distinct()
        return SqlResult(kind, ["eid"], rows)

    def update(self, alias: str, sets: list, where: Any, binder: Binder) -> SqlResult:
        first = len(self.scratch)
        with self.transaction() as t:
            plain, terms = {}, {}
            for name, node in sets:
                self.writable(name)
                if isinstance(node, sql.Field) and not (node.alias == "tx"):
                    terms[name] = binder.field(node)
                else:
                    plain[name] = self.value(node, {"tx": t}, binder)
            found = self.matches(alias, where, (), {f"set {n}": v for n, v in terms.items()}, binder)
            found = self.pinned(found)
            for name, value in plain.items():
                a = self.catalog.get(name)
                if value is not None:
                    stored = coerce(value, a.type)
                    column = F.timestamp_micros(F.lit(stored)) if a.type == ValueType.INSTANT else F.lit(stored)
                    self.save_many(name, found.select(F.col("eid").alias("e"), column.alias("v")))
            for name in terms:
                self.save_many(name, found.select(F.col("eid").alias("e"), F.col(f"`set {name}`").alias("v")))
        self.clean(first)
        return self.changed("UPDATE", t)

    def pinned(self, df: DataFrame, what: str = "match") -> DataFrame:
        """df as a written table, so that facts written meanwhile don't change it."""
        path = f"{self.store.path}/_{what}-{uuid.uuid4().hex}"
        names = df.columns
        df = df.toDF(*[f"c{i}" for i in range(len(names))])
        df.write.parquet(path)
        self.scratch.append(path)
        return self.spark.read.schema(df.schema).parquet(path).toDF(*names)

    def delete(self, where: Any, binder: Binder) -> SqlResult:
        first = len(self.scratch)
        with self.transaction() as t:
            condition = binder.condition(where)
            alias = "d1" if "d1" in binder.aliases else next(iter(binder.aliases), "d1")
            attrs = list(binder.aliases[alias].attrs)
            eid = binder.field(sql.Field(alias, "eid"))
            query = binder.finish([("eid", eid), *[(f"v{i}", Var(f"{alias}.{n}")) for i, n in enumerate(attrs)]], condition)
            found = self.compiler(query).result().distinct()
            found = self.pinned(found)
            for i, name in enumerate(attrs):
                self.retract_many(name, found.select(F.col("eid").alias("e"), F.col(f"v{i}").alias("v")))
            if not attrs:
                for a in [a for a in self.catalog.attributes.values() if a.source is None and self.store.holds(a) and not a.name.startswith("db.")]:
                    gone = self.current(a.name).join(found.select(F.col("eid").alias("e")).distinct(), "e", "left_semi").select("e", "v")
                    self.retract_many(a.name, gone)
        self.clean(first)
        return self.changed("DELETE", t)

    # -- whole-log reading
    def dump(self, index: str = "EAVT") -> DataFrame:
        """Every asserted fact as (e, a, attr, val, t), in the order of an index."""
        order = {"EAVT": ["e", "a"], "AEVT": ["a", "e"], "AVET": ["a", "val", "e"], "VAET": ["val", "a", "e"]}[index.upper()]
        parts, tables, sizes = [], {}, []
        for a in self.catalog.attributes.values():
            if index.upper() == "VAET" and a.type != ValueType.REF or index.upper() == "AVET" and not (a.unique or a.indexed):
                continue
            if a.source is not None:
                tables.setdefault(id(a.source), []).append(a)
            elif self.store.holds(a):
                rows = self.store.attribute(a)
                sizes.append((rows, 1))
                parts.append(rows.where("added").select("e", F.lit(a.aid).alias("a"), F.lit(a.name).alias("attr"), rendered(F.col("v"), a.type).alias("val"), "t"))
        for attrs in tables.values():  # one scan a table
            source = attrs[0].source
            sizes.append((source.table(False), len(attrs)))
            values = [F.struct(F.lit(a.aid).alias("a"), F.lit(a.name).alias("attr"), rendered(source.columns[a.name], a.type).alias("val")) for a in attrs]
            rows = source.table(True).select(source.eid().alias("e"), F.explode(F.array(*values)).alias("f"))
            parts.append(rows.where("f.val is not null").select("e", "f.a", "f.attr", "f.val", F.lit(source.load_tx).cast("long").alias("t")))
        # no column is read: of tables only the footers
        n = reduce(DataFrame.unionAll, [df.select(F.lit(each).cast("long").alias("n")) for df, each in sizes]).agg(F.sum("n")).first()[0]
        return in_order(reduce(DataFrame.unionAll, parts), n or 0, *order, "val", "t")

    def prepare(self, find: list[str], where: list[tuple], ranges: dict | None = None, given: dict | None = None) -> Any:
        from .datalog import Prepared

        return Prepared(self, find, where, ranges or {}, given or {})


__all__ = ["COLUMN", "Session", "SqlResult", "UniqueError"]
