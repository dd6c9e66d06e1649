"""What SQL and datalog are bound to: patterns over facts, a condition, and what to find."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, ClassVar


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Arith:
    """+ - * / mod, neg or a function over terms; case has conditions before its values."""

    op: str
    args: tuple


Term = Var | Const | Arith


@dataclass(frozen=True)
class Agg:
    """count, sum, avg, min or max of a term over the rows of a group; count may have none."""

    name: str
    arg: Term | None = None
    distinct: bool = False


Slot = Var | Const | None


@dataclass(frozen=True)
class Pattern:
    """A fact with some slots bound; a is an attribute's name where it is a constant."""

    e: Slot
    a: Slot
    v: Slot
    t: Slot = None
    added: Slot = None

    def variables(self) -> list[str]:
        return [s.name for s in (self.e, self.a, self.v, self.t, self.added) if isinstance(s, Var)]


@dataclass
class Cmp:
    op: str
    left: Term
    right: Term
    OPS: ClassVar = ("=", "!=", "<", "<=", ">", ">=")


@dataclass
class In:
    term: Term
    values: list[Term]
    negated: bool = False


@dataclass
class And:
    parts: list


@dataclass
class Or:
    parts: list


@dataclass
class Not:
    part: Any


@dataclass
class Query:
    find: list[tuple[str, Term]]
    patterns: list[Pattern]
    condition: Any = None
    history: bool = False
    exists: bool = False
    distinct: bool = False
    group: list[Term] = field(default_factory=list)
    order: list[tuple[Term, bool]] = field(default_factory=list)  # descending or not
    limit: int | None = None


def conjuncts(node: Any) -> list:
    if node is None:
        return []
    return [c for p in node.parts for c in conjuncts(p)] if isinstance(node, And) else [node]


def variables(node: Any) -> set[str]:
    match node:
        case Var(name):
            return {name}
        case Arith(_, args):
            return set().union(*map(variables, args)) if args else set()
        case Cmp(_, left, right):
            return variables(left) | variables(right)
        case In(term, values):
            return variables(term).union(*map(variables, values))
        case And(parts) | Or(parts):
            return set().union(*map(variables, parts)) if parts else set()
        case Not(part) | Agg(_, part):
            return variables(part)
    return set()


def substituted(node: Any, new: dict[str, Any]) -> Any:
    """node with variables replaced."""
    match node:
        case Var(name):
            return new.get(name, node)
        case Arith(op, args):
            return Arith(op, tuple(substituted(a, new) for a in args))
        case Cmp(op, left, right):
            return Cmp(op, substituted(left, new), substituted(right, new))
        case In(term, values, negated):
            return In(substituted(term, new), [substituted(v, new) for v in values], negated)
        case And(parts):
            return And([substituted(p, new) for p in parts])
        case Or(parts):
            return Or([substituted(p, new) for p in parts])
        case Not(part):
            return Not(substituted(part, new))
        case Agg(name, arg, distinct):
            return Agg(name, substituted(arg, new), distinct)
        case Pattern(e, a, v, t, added):
            return Pattern(*(substituted(s, new) for s in (e, a, v, t, added)))
    return node
