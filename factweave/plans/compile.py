"""Pattern queries to DataFrames.

Rewrites made here, before Catalyst: patterns on one entity that come from one table become one scan
(R1); a constant attribute reads its column or partition only (R2); conditions on entity ids become
conditions on the plain key, which reach the scan (R3); joins start from the most selective part and
stay connected (R4); slots nobody asks for are existential (R5); equal variables are one (R6, in the
binder); a join on values that are no key of either side is dealt by blocks of their rows where it
makes many (R7). The rest - pushdown, pruning, join strategy, skew - is Catalyst's and AQE's."""

from __future__ import annotations

import operator
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import partition_of
from ..functions.values import COLUMN, COLUMNS, ValueType, fits, literal, rendered
from ..operators.joins import value_join
from ..operators.views import View, facts
from ..sources.catalog import Attribute
from .ir import Agg, And, Cmp, Const, In, Not, Or, Pattern, Query, Term, Var, conjuncts, variables

COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "like": F.like}


@dataclass
class Unit:
    """A part of the join: a frame whose columns are the variables, and how selective it is."""

    frame: DataFrame
    variables: dict[str, ValueType | None]
    rank: int
    what: str
    patterns: list[Pattern] = field(default_factory=list)
    size: float = float("inf")  # facts, as far as the commits tell
    keys: set[str] = field(default_factory=set)  # variables of which no two rows have the same value


class Compiler:
    def __init__(self, session: Any, query: Query, view: View, coalesce: bool = True):
        self.session, self.query, self.coalesce = session, query, coalesce
        self.view = View(view.as_of, view.history or query.history)
        self.kinds: dict[str, ValueType | None] = {}
        self.used = {v for _, t in query.find for v in variables(t)} | variables(query.condition) | {v for t in [*query.group, *(t for t, _ in query.order)] for v in variables(t)}
        self.plan: list[str] = []

    # -- units
    def units(self) -> list[Unit]:
        groups: dict[Any, list[Pattern]] = {}
        out: list[Unit] = []
        for k, p in enumerate(self.query.patterns):
            a = self.session.catalog.get(p.a.value) if isinstance(p.a, Const) else None
            if a is None:
                out.append(self.wildcard(p))
            elif a.source is not None:
                groups.setdefault((id(a.source), p.e, p.t, p.added) if self.coalesce else k, []).append(p)
            else:
                out.append(self.logged(p, a))
        return [self.relational(ps) for ps in groups.values()] + out

    def shared(self, patterns: list[Pattern], name: str) -> bool:
        return name in self.used or any(name in p.variables() for p in self.query.patterns if p not in patterns)

    def relational(self, patterns: list[Pattern]) -> Unit:
        attrs = [self.session.catalog.get(p.a.value) for p in patterns]
        source, first = attrs[0].source, patterns[0]
        own_ref = any(isinstance(p.v, Var) and p.v == p.e for p in patterns)
        ids = isinstance(first.e, Const) or own_ref or isinstance(first.e, Var) and self.shared(patterns, first.e.name)
        df, where, columns, kinds, rank = source.table(ids), [], {}, {}, 50
        if isinstance(first.e, Const):
            where.append(source.compare_key(operator.eq, first.e.value))
            rank = 0
        elif ids and isinstance(first.e, Var):
            columns[first.e.name], kinds[first.e.name] = source.eid(), ValueType.REF
            for c in conjuncts(self.query.condition):
                if isinstance(c, Cmp) and c.left == first.e and isinstance(c.right, Const) and isinstance(c.right.value, int):
                    where.append(source.compare_key(COMPARE[c.op], c.right.value))
                    rank = min(rank, 30)
        for p, a in zip(patterns, attrs, strict=True):
            value = source.columns[a.name]
            where.append(value.isNotNull())
            rank = min(rank, self.bind(p.v, value, a, columns, kinds, where))
        for slot, value, kind in ((first.t, F.lit(source.load_tx), ValueType.REF), (first.added, F.lit(True), ValueType.BOOLEAN)):
            self.bind(slot, value, kind, columns, kinds, where)
        if self.view.as_of is not None and self.view.as_of < source.load_tx:
            where.append(F.lit(False))
        df = df.where(reduce(operator.and_, where)).select(*[c.alias(n) for n, c in columns.items()])
        keys = {p.v.name for p, a in zip(patterns, attrs, strict=True) if a.unique and isinstance(p.v, Var)} | ({first.e.name} if isinstance(first.e, Var) else set())
        return Unit(df, kinds, rank, f"scan {', '.join(a.name for a in attrs)}", patterns, keys=keys & set(kinds))

    def bind(self, slot: Any, value: Column, a: Attribute | ValueType, columns: dict, kinds: dict, where: list) -> int:
        kind = a.type if isinstance(a, Attribute) else a
        if isinstance(slot, Const):
            where.append(value == literal(slot.value, kind) if fits(slot.value, kind) else F.lit(False))
            return 5 if isinstance(a, Attribute) and a.unique else 20
        if isinstance(slot, Var):
            if slot.name in columns:
                where.append(columns[slot.name] == value)
            else:
                columns[slot.name], kinds[slot.name] = value, kind
            for c in conjuncts(self.query.condition):
                if isinstance(c, Cmp) and c.left == slot and isinstance(c.right, Const):
                    return (5 if isinstance(a, Attribute) and a.unique else 20) if c.op == "=" else 40
                if isinstance(c, In) and c.term == slot:
                    return 30
        return 50

    def logged(self, p: Pattern, a: Attribute) -> Unit:
        log = self.session.store.attribute(a)
        # as in the log: filters on the fact go below the view's aggregate
        where = []
        if isinstance(p.e, Const):
            where.append(F.col("e") == F.lit(p.e.value))
        if isinstance(p.v, Const):
            where.append(F.col("v") == literal(p.v.value, a.type) if fits(p.v.value, a.type) else F.lit(False))
        if where:
            log = log.where(reduce(operator.and_, where))
        df = facts(log, self.view, retracted=a.retracted)
        unit = self.project(df, p, {"e": ValueType.REF, "v": a.type, "t": ValueType.REF, "added": ValueType.BOOLEAN}, f"facts {a.name}", 10 if where else 45)
        if a.aid not in self.session.store.attached:
            unit.size = self.session.store.estimate(a)
        if not self.view.history:
            once = [p.e] * (not a.many) + [p.v] * a.unique
            unit.keys = {x.name for x in once if isinstance(x, Var)} & set(unit.variables)
        return unit

    def partitions(self, p: Pattern) -> set[int] | None:
        """The id partitions that p's entities can be of, None if any: a constant's own, or those of
        the tables whose attributes other patterns ask of the same variable."""
        if isinstance(p.e, Const):
            return {partition_of(p.e.value)}
        found: set[int] | None = None
        for other in self.query.patterns:
            a = self.session.catalog.get(other.a.value) if other.e == p.e and isinstance(p.e, Var) and isinstance(other.a, Const) else None
            if a is not None and a.source is not None:
                found = {a.source.partition} if found is None else found & {a.source.partition}
        return found

    def wildcard(self, p: Pattern) -> Unit:
        """A pattern without a constant attribute: the union over attributes that can match. The
        attributes of one table come from one scan, each row giving one fact for each value."""
        catalog, store = self.session.catalog, self.session.store
        could = [a for a in catalog.attributes.values() if not (isinstance(p.v, Const) and not fits(p.v.value, a.type))]
        where = self.partitions(p)
        tables: dict[int, list[Attribute]] = {}
        logged = []
        for a in could:
            if a.source is not None:
                if (where is None or a.source.partition in where) and (self.view.as_of is None or self.view.as_of >= a.source.load_tx):
                    tables.setdefault(id(a.source), []).append(a)
            elif store.holds(a):
                logged.append(a)
        kinds = {a.type for a in [*(a for t in tables.values() for a in t), *logged]}
        kind = kinds.pop() if len(kinds) == 1 else None
        found = lambda v, a: v if kind else rendered(v, a.type)
        frames = []
        for attrs in tables.values():
            source = attrs[0].source
            df = source.table(True)
            if isinstance(p.e, Const):
                df = df.where(source.compare_key(operator.eq, p.e.value))
            for c in conjuncts(self.query.condition):
                if isinstance(c, Cmp) and c.left == p.e and isinstance(p.e, Var) and isinstance(c.right, Const) and isinstance(c.right.value, int):
                    df = df.where(source.compare_key(COMPARE[c.op], c.right.value))
            values = []
            for a in attrs:
                v = source.columns[a.name]
                value = found(v, a)
                values.append(F.struct(F.lit(a.name).alias("a"), (F.when(v == literal(p.v.value, a.type), value) if isinstance(p.v, Const) else value).alias("v")))
            df = df.select(source.eid().alias("e"), F.explode(F.array(*values)).alias("f")).where("f.v is not null")
            frames.append(df.select("e", "f.a", "f.v", F.lit(source.load_tx).cast("long").alias("t"), F.lit(True).alias("added")))
        held = lambda a: a.aid in store.attached
        for a in filter(held, logged):
            if isinstance(p.e, Const) and store.homes[a.aid] not in (None, partition_of(p.e.value)):
                continue
            log = store.attribute(a)
            if isinstance(p.e, Const):
                log = log.where(F.col("e") == F.lit(p.e.value))
            if isinstance(p.v, Const):
                log = log.where(F.col("v") == literal(p.v.value, a.type))
            frames.append(facts(log, self.view, retracted=a.retracted).select("e", F.lit(a.name).alias("a"), found(F.col("v"), a).alias("v"), "t", "added"))
        if own := [a for a in logged if not held(a)]:
            frames.append(self.any_logged(p, own, kind))
        df = reduce(DataFrame.unionAll, frames) if frames else self.session.spark.createDataFrame([], "e long, a string, v string, t long, added boolean")
        if isinstance(p.a, Const):
            df = df.where(F.col("a") == F.lit(str(p.a.value)))
        kinds_of = {"e": ValueType.REF, "a": ValueType.STRING, "v": kind or ValueType.STRING, "t": ValueType.REF, "added": ValueType.BOOLEAN}
        # constants of v were compared in their own types above
        p = Pattern(p.e, p.a, None if isinstance(p.v, Const) else p.v, p.t, p.added)
        return self.project(df, p, kinds_of, "facts of any attribute", 10 if isinstance(p.e, Const) else 60, fixed_v=True)

    def any_logged(self, p: Pattern, attrs: list[Attribute], kind: ValueType | None) -> DataFrame:
        """(e, a, v, t, added) of several attributes of the log, from one scan; v is text if they are of
        several types."""
        log = self.session.store.log().where(F.col("a").isin([a.aid for a in attrs]))
        if isinstance(p.e, Const):
            log = log.where(F.col("e") == F.lit(p.e.value))
        if isinstance(p.v, Const):
            some = F.lit(False)
            for t in {a.type for a in attrs}:
                value = F.timestamp_micros(COLUMN[t]) if t == ValueType.INSTANT else F.col(COLUMN[t])
                some |= F.col("a").isin([a.aid for a in attrs if a.type == t]) & (value == literal(p.v.value, t))
            log = log.where(some)
        if kind is None:  # an instant is stored as the number that it is rendered as
            value = F.coalesce(*[F.base64(c) if c == "v_bin" else F.col(c).cast("string") for c in COLUMNS])
        else:
            value = F.timestamp_micros(COLUMN[kind]) if kind == ValueType.INSTANT else F.col(COLUMN[kind])
        names = F.create_map(*[F.lit(x) for a in attrs for x in (a.aid, a.name)])
        log = log.select("e", names[F.col("a")].alias("a"), value.alias("v"), "t", "added")
        return facts(log, self.view, keys=("e", "a", "v"), retracted=any(a.retracted for a in attrs))

    def project(self, df: DataFrame, p: Pattern, kinds_of: dict, what: str, rank: int, fixed_v: bool = False) -> Unit:
        columns, kinds, where = {}, {}, []
        slots = {"e": p.e, "a": p.a if "a" in kinds_of else None, "v": p.v, "t": p.t, "added": p.added}
        for c, slot in slots.items():
            if not (c == "v" and isinstance(slot, Const)):  # compared already, in the attribute's own type
                rank = min(rank, self.bind(slot, F.col(c), kinds_of.get(c), columns, kinds, where))
        if where:
            df = df.where(reduce(operator.and_, where))
        df = df.select(*[c.alias(n) for n, c in columns.items()])
        # slots that nobody binds exist or not: they don't multiply rows. One that stands before a
        # bound slot does.
        order = [s for s in slots.values()]
        last = max((i for i, s in enumerate(order) if isinstance(s, Var | Const)), default=-1)
        trailing = any(s is None for s in order[last + 1 :])
        exact = isinstance(p.t, Var) and isinstance(p.added, Var)
        v_free = p.v is None and not fixed_v or fixed_v and p.v is None
        if columns and trailing and (v_free or self.view.history and not exact):
            df = df.distinct()
        return Unit(df, kinds, rank, what, [p])

    # -- terms and conditions
    def column(self, term: Term, kind: ValueType | None = None) -> Column:
        if isinstance(term, Var):
            return F.col(f"`{term.name}`")
        if isinstance(term, Const):
            return literal(term.value, kind) if kind is not None and fits(term.value, kind) else F.lit(term.value)
        if term.op == "case":
            *whens, other = term.args
            out = None
            for c, v in zip(whens[::2], whens[1::2], strict=True):
                out = (F if out is None else out).when(self.condition(c), self.column(v))
            return out.otherwise(self.column(other))
        args = [self.column(a) for a in term.args]
        if term.op.startswith("call "):
            return self.session.functions[term.op[5:]](*args)
        return arithmetic(term.op, args)

    def aggregate(self, a: Agg) -> Column:
        if a.arg is None:
            return F.count(F.lit(1))
        value = self.column(a.arg)
        if a.name == "count":
            return F.count_distinct(value) if a.distinct else F.count(value)
        if a.distinct and a.name in ("sum", "avg"):
            return {"sum": F.sum_distinct, "avg": lambda v: F.sum_distinct(v) / F.count_distinct(v)}[a.name](value)
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.name](value)

    def kind_of(self, term: Term) -> ValueType | None:
        return self.kinds.get(term.name) if isinstance(term, Var) else None

    def condition(self, node: Any) -> Column:
        if isinstance(node, And):
            return reduce(operator.and_, map(self.condition, node.parts), F.lit(True))
        if isinstance(node, Or):
            return reduce(operator.or_, map(self.condition, node.parts), F.lit(False))
        if isinstance(node, Not):
            return ~self.condition(node.part)
        if isinstance(node, In):
            kind = self.kind_of(node.term)
            values = [v for v in node.values if kind is None or not isinstance(v, Const) or fits(v.value, kind)]
            found = self.column(node.term).isin([self.column(v, kind) for v in values]) if values else F.lit(False)
            return ~found if node.negated else found
        kind = self.kind_of(node.left) or self.kind_of(node.right)
        for side in (node.left, node.right):
            if isinstance(side, Const) and kind is not None and not fits(side.value, kind):
                raise TypeError(f"{side.value!r} compared with {kind.name}")
        return COMPARE[node.op](self.column(node.left, kind), self.column(node.right, kind))

    # -- joins
    def join(self, left: Unit, right: Unit) -> Unit:
        """Joined on their common variables. What matches a key stays as it was: the other's keys hold on."""
        common = [v for v in right.variables if v in left.variables]
        kinds = left.variables | right.variables
        keys = (left.keys if right.keys & set(common) else set()) | (right.keys if left.keys & set(common) else set())
        if not common:
            return Unit(left.frame.crossJoin(right.frame), kinds, 0, "")
        renamed = right.frame.select(*[F.col(f"`{c}`").alias(f"{c}'" if c in common else c) for c in right.frame.columns])
        if (left.keys | right.keys) & set(common):
            joined = left.frame.join(renamed, reduce(operator.and_, [same(left.frame, c, renamed, f"{c}'") for c in common]))
        else:  # a value of many rows on both sides
            joined = value_join(left.frame, renamed, [(c, f"{c}'") for c in common])
        return Unit(joined.drop(*[f"{c}'" for c in common]), kinds, 0, "", keys=keys)

    def frame(self) -> DataFrame:
        """The match: one row for each binding, with a column for each variable."""
        left = sorted(self.units(), key=lambda u: (u.rank, u.size))
        if not left:
            return self.session.spark.range(1).select()
        for u in left:
            self.kinds |= u.variables
        todo = conjuncts(self.query.condition)

        def filtered(u: Unit) -> Unit:
            nonlocal todo
            ready = [c for c in todo if variables(c) <= set(u.variables)]
            todo = [c for c in todo if c not in ready]
            return replace(u, frame=u.frame.where(reduce(operator.and_, map(self.condition, ready)))) if ready else u

        left = [filtered(u) for u in left]
        now = left.pop(0)
        self.plan.append(now.what)
        while left:
            near = next((u for u in left if not u.variables or set(u.variables) & set(now.variables)), left[0])
            left.remove(near)
            self.plan.append(f"join {near.what} on {', '.join(sorted(set(near.variables) & set(now.variables))) or 'nothing'}")
            if near.variables:
                now = filtered(self.join(now, near))
            else:  # a fully bound pattern only has to exist
                now = Unit(now.frame.join(near.frame.limit(1).withColumn("_", F.lit(1)), F.lit(True), "left_semi"), now.variables, 0, "", keys=now.keys)
        out = now.frame
        return out.where(reduce(operator.and_, map(self.condition, todo))) if todo else out

    def result(self) -> DataFrame:
        match, query = self.frame(), self.query
        taken: dict[str, int] = {}
        names = []
        for name, _ in query.find:
            taken[name] = taken.get(name, 0) + 1
            names.append(name if taken[name] == 1 else f"{name}_{taken[name]}")
        terms = [t for _, t in query.find]
        # what rows are ordered by that isn't found as well
        hidden = [t for t, _ in query.order if t not in terms]
        if any(isinstance(t, Agg) for t in [*terms, *hidden]) or query.group:
            keys = [*query.group, *(t for t in terms if not isinstance(t, Agg | Const) and t not in query.group)]
            match = match.groupBy(*[self.column(t).alias(f"key {i}") for i, t in enumerate(keys)])
            wanted = [t for t in dict.fromkeys([*terms, *hidden]) if isinstance(t, Agg)]
            match = match.agg(*[self.aggregate(t).alias(f"of {i}") for i, t in enumerate(wanted)]) if wanted else match.agg(F.count(F.lit(1)).alias("rows"))
            column = lambda t: F.lit(t.value) if isinstance(t, Const) else F.col(f"`of {wanted.index(t)}`" if isinstance(t, Agg) else f"`key {keys.index(t)}`")
        else:
            column = self.column
        columns = [column(t).alias(n) for n, t in zip(names, terms, strict=True)]
        if query.exists:
            return match.limit(1).select(*columns)
        extra = [f"order {i}" for i in range(len(hidden))]
        out = match.select(*columns, *[column(t).alias(n) for n, t in zip(extra, hidden, strict=True)])
        out = out.distinct() if query.distinct else out
        if query.order:
            place = lambda t: F.col(f"`{extra[hidden.index(t)] if t in hidden else names[terms.index(t)]}`")
            out = out.orderBy(*[place(t).desc() if down else place(t).asc() for t, down in query.order])
        if query.limit is not None:
            out = out.limit(query.limit)
        return out.drop(*extra) if extra else out


def same(left: DataFrame, a: str, right: DataFrame, b: str) -> Column:
    x, y = left[f"`{a}`"], right[f"`{b}`"]
    kinds = dict(left.dtypes)[a], dict(right.dtypes)[b]
    number = {"int", "bigint", "double", "float", "smallint"}
    return x == y if kinds[0] == kinds[1] or set(kinds) <= number else x.cast("string") == y.cast("string")


def arithmetic(op: str, args: list[Column]) -> Column:
    """Integers stay exact longs; / gives a double; a zero divisor is an error."""
    if op == "neg":
        return -args[0]
    scalars = {"abs": F.abs, "least": F.least, "greatest": F.greatest, "lower": F.lower, "upper": F.upper, "length": F.length}
    if op in scalars:
        return scalars[op](*args) if len(args) > 1 or op not in ("least", "greatest") else args[0]
    a, b = args
    if op == "/":
        return a.cast("double") / b.cast("double")
    return {"+": operator.add, "-": operator.sub, "*": operator.mul, "mod": operator.mod}[op](a, b)
