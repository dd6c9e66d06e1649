"""Statements to patterns: aliases, equal variables, parameters and names."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass, field
from typing import Any

from ..sources.catalog import Catalog, SchemaError
from .ir import Agg, And, Arith, Cmp, Const, In, Not, Or, Pattern, Query, Term, Var, conjuncts, substituted
from . import parser
from .parser import BUILT_IN, Both, Call, Case, Compare, Either, Field, Literal, Op, Param, Select, SqlError

Lookup = Callable[[str, tuple], Any]


@dataclass
class Alias:
    attrs: list[str] = field(default_factory=list)
    wants: set[str] = field(default_factory=set)


class Binder:
    """lookup(name, args) answers eid() and val()."""

    def __init__(self, catalog: Catalog, params: tuple, lookup: Lookup, functions: Collection[str] = ()):
        self.catalog, self.params, self.lookup, self.functions = catalog, params, lookup, functions
        self.aliases: dict[str, Alias] = {}

    # -- terms
    def term(self, node: Any) -> Term:
        if isinstance(node, Literal):
            return Const(node.value)
        if isinstance(node, Param):
            if not 1 <= node.number <= len(self.params):
                raise SqlError(f"parameter %{node.number} of {len(self.params)}")
            return Const(self.params[node.number - 1])
        if isinstance(node, Op) and node.op.startswith("call ") and node.op[5:] not in self.functions:
            raise SqlError(f"unknown function {node.op[5:]}")
        if isinstance(node, Op):
            return Arith(node.op, tuple(self.term(a) for a in node.args))
        if isinstance(node, Case):
            return Arith("case", (*[x for c, v in node.whens for x in (self.condition(c), self.term(v))], self.term(node.other)))
        if isinstance(node, Call):
            args = [self.term(a) for a in node.args]
            if not all(isinstance(a, Const) for a in args):
                raise SqlError(f"{node.name}() takes constants here")
            return Const(self.lookup(node.name, tuple(a.value for a in args)))
        if isinstance(node, Field):
            return self.field(node)
        raise SqlError(f"no value: {node!r}")

    def field(self, f: Field) -> Var:
        alias = self.aliases.setdefault(f.alias, Alias())
        if f.name in BUILT_IN:
            alias.wants.add(f.name)
            return Var(f"{f.alias}.{f.name}")
        name = self.catalog.get(f.name).name
        if name not in alias.attrs:
            alias.attrs.append(name)
        return Var(f"{f.alias}.{name}")

    def condition(self, node: Any) -> Any:
        if isinstance(node, Both):
            return And([self.condition(p) for p in node.parts])
        if isinstance(node, Either):
            return Or([self.condition(p) for p in node.parts])
        if isinstance(node, parser.Not):
            return Not(self.condition(node.part))
        assert isinstance(node, Compare)
        left = self.term(node.left)
        if node.op == "like" and not (isinstance(pattern := self.term(node.right), Const) and isinstance(pattern.value, str)):
            raise SqlError("LIKE takes a text")
        if isinstance(node.right, list):
            return In(left, [self.term(v) for v in node.right], node.op == "not in")
        return Cmp(node.op, left, self.term(node.right))

    # -- statements
    def select(self, s: Select) -> Query:
        condition = self.condition(s.where) if s.where is not None else None
        known = set(self.aliases)
        if s.star:
            alias = next(iter(self.aliases), "d1")
            fields = ["eid", "attr", "val", *(["tx", "added"] if s.history else [])]
            find = [(f, self.field(Field(alias, f))) for f in fields]
        else:
            find = [(n, self.item(i)) for n, i in zip(s.names, s.items, strict=True)]
        group = [self.term(g) for g in s.group]
        if group and (loose := [n for n, t in find if not isinstance(t, Agg | Const) and t not in group]):
            raise SqlError(f"{', '.join(loose)} is neither grouped nor aggregated")
        order = []
        for item, down in s.order:
            if isinstance(item, Literal) and isinstance(item.value, int):
                if not 1 <= item.value <= len(find):
                    raise SqlError(f"ORDER BY {item.value} of {len(find)} items")
                order.append((find[item.value - 1][1], down))
            else:
                order.append((self.item(item), down))
        limit = None if s.limit is None else self.term(s.limit).value
        if s.where is not None and (unknown := set(self.aliases) - known):
            raise SqlError(f"{', '.join(sorted(unknown))} isn't in WHERE")
        constant = all(isinstance(t, Const) for _, t in find)
        return self.finish(find, condition, s.history, exists=bool(s.where is not None and constant and find), group=group, order=order, limit=limit)

    def item(self, node: Any) -> Term | Agg:
        """A term of the item list, where aggregates may stand."""
        if isinstance(node, parser.Aggregate):
            return Agg(node.name, None if node.arg is None else self.term(node.arg), node.distinct)
        return self.term(node)

    def finish(self, find: list[tuple[str, Term]], condition: Any, history: bool = False, exists: bool = False, **more: Any) -> Query:
        patterns = []
        for name, alias in sorted(self.aliases.items()):
            patterns += self.patterns(name, alias)
        return unified(Query(find, patterns, condition, history, exists, **more))

    def patterns(self, name: str, alias: Alias) -> list[Pattern]:
        slot = lambda f: Var(f"{name}.{f}") if f in alias.wants else None
        e, t, added = Var(f"{name}.eid"), slot("tx"), slot("added")
        out = [Pattern(e, Const(a), Var(f"{name}.{a}"), t, added) for a in alias.attrs]
        if alias.wants & {"attr", "val"} or not alias.attrs:
            out.append(Pattern(e, slot("attr"), slot("val"), t, added))
        return out


def unified(query: Query) -> Query:
    """Equalities of two variables that every row must meet make them one variable, and equalities
    with a constant fill the slot; both vanish from the condition."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    rest, constants = [], {}
    for c in conjuncts(query.condition):
        if isinstance(c, Cmp) and c.op == "=" and isinstance(c.left, Var) and isinstance(c.right, Var):
            a, b = find(c.left.name), find(c.right.name)
            if a != b:
                # an entity's variable stays, for its other patterns
                a, b = (b, a) if not a.endswith(".eid") and b.endswith(".eid") else (a, b)
                parent[b] = a
        else:
            rest.append(c)
    names = {v for p in query.patterns for v in p.variables()}
    new = {v: Var(find(v)) for v in names if find(v) != v}
    left = []
    for c in rest:
        c = substituted(c, new)
        if isinstance(c, Cmp) and c.op == "=" and isinstance(c.left, Var) and isinstance(c.right, Const) and c.left.name.endswith(".eid") and c.left.name not in constants:
            constants[c.left.name] = c.right
        else:
            left.append(c)
    patterns = [substituted(substituted(p, new), constants) for p in query.patterns]
    found = [(n, substituted(substituted(t, new), constants)) for n, t in query.find]
    bare = [p for p in patterns if not (isinstance(p.e, Var) and p.a is None and p.v is None and p.t is None and p.added is None and any(q is not p and q.e == p.e or p.e in (q.v, q.t) and q is not p for q in patterns))]
    # `d2` alone only names an entity that other patterns bind
    condition = substituted(And(left), constants) if left else None
    group = [substituted(substituted(t, new), constants) for t in query.group]
    order = [(substituted(substituted(t, new), constants), down) for t, down in query.order]
    return Query(found, bare or patterns, condition, query.history, query.exists, query.distinct, group, order, query.limit)


__all__ = ["Binder", "SchemaError"]
