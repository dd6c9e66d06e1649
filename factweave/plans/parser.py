"""The SQL dialect: tokens and a recursive-descent parser.

    SELECT [HISTORY] items [WHERE condition] [GROUP BY items] [ORDER BY items [ASC | DESC]] [LIMIT n]
    UPSERT [AS alias [= eid(..) | = %n]] SET attr = value, .. [, AS alias ..]
    UPDATE [AS alias] SET attr = value, .. WHERE condition
    DELETE WHERE condition
    ATTRIBUTE ns.attr TYPE [ONE | MANY] [UNIQUE]
    PARTITION name
    EXPLAIN statement          DATALOG SELECT ..

Conditions: comparisons, eid IN BITMAP(attr = value, ..), [NOT] IN, [NOT] BETWEEN, [NOT] LIKE, NOT, AND, OR. Values: + - * / MOD, ABS,
LEAST, GREATEST (or MIN and MAX of several), LOWER, UPPER, LENGTH, CASE WHEN, functions that the
session has registered. Aggregates in items:
COUNT, SUM, AVG, MIN, MAX; the other items are the groups.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class SqlError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    """alias.name; name is eid, tx, attr, val, added or an attribute."""

    alias: str
    name: str


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Param:
    number: int


@dataclass(frozen=True)
class Call:
    """eid(attr, value) or val(entity, attr)."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Case:
    """(condition, value) pairs, and the value of rows that meet none."""

    whens: tuple
    other: Any


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: Any = None  # of COUNT(*)
    distinct: bool = False


@dataclass
class Not:
    part: Any


@dataclass
class Compare:
    op: str
    left: Any
    right: Any  # a list for IN


@dataclass
class Both:
    parts: list


@dataclass
class Either:
    parts: list


@dataclass
class Select:
    items: list
    star: bool = False
    where: Any = None
    history: bool = False
    names: list[str] = field(default_factory=list)
    group: list = field(default_factory=list)
    order: list[tuple[Any, bool]] = field(default_factory=list)  # descending or not
    limit: Any = None


@dataclass
class Clause:
    alias: str
    entity: Any = None
    sets: list[tuple[str, Any]] = field(default_factory=list)
    where: Any = None


@dataclass
class Upsert:
    clauses: list[Clause]


@dataclass
class Update:
    alias: str
    sets: list[tuple[str, Any]]
    where: Any


@dataclass
class Delete:
    where: Any


@dataclass
class DeclareAttribute:
    name: str
    type: str
    many: bool
    unique: bool


@dataclass
class DeclarePartition:
    name: str


@dataclass
class Explain:
    statement: Any


TOKEN = re.compile(
    r"\s*(?:(?P<float>\d+\.\d+)|(?P<int>\d+)|(?P<param>%\d+)|(?P<str>'(?:[^']|'')*')|(?P<word>:?[A-Za-z_][\w/]*(?:\.[A-Za-z_][\w/]*)*)|(?P<op><>|!=|<=|>=|[-+*/=<>(),;])|(?P<end>$)|(?P<bad>.))"
)
KEYWORDS = {"SELECT", "WHERE", "AND", "OR", "IN", "HISTORY", "UPSERT", "UPDATE", "DELETE", "SET", "AS", "ATTRIBUTE", "PARTITION", "EXPLAIN", "DATALOG", "MOD", "TRUE", "FALSE", "NOT", "LIKE", "BETWEEN", "GROUP", "ORDER", "BY", "ASC", "DESC", "LIMIT", "CASE", "WHEN", "THEN", "ELSE", "END", "DISTINCT"}
SCALARS = {"abs": "abs", "least": "least", "greatest": "greatest", "min": "least", "max": "greatest", "lower": "lower", "upper": "upper", "length": "length"}
AGGREGATES = {"count", "sum", "avg", "min", "max"}
BUILT_IN = ("eid", "tx", "attr", "val", "added")
ALIAS = re.compile(r"[dD]\d+$")
FLIPPED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass
class Token:
    kind: str
    text: str
    at: int


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while True:
        m = TOKEN.match(sql, at)
        kind = m.lastgroup
        text, start = m[kind], m.start(kind)
        if kind == "bad":
            raise SqlError(f"unexpected {text!r} at {start}")
        if kind == "word" and text.upper() in KEYWORDS:
            kind, text = "key", text.upper()
        out.append(Token(kind, text, start))
        if kind == "end":
            return out
        at = m.end()


class Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, self.at = sql, tokens(sql), 0

    # -- basics
    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, wanted: str) -> SqlError:
        return SqlError(f"expected {wanted} at {self.now.at}, found {self.now.text or 'the end'!r}")

    def take(self, *texts: str) -> Token | None:
        if self.now.kind in ("key", "op") and self.now.text in texts:
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def need(self, *texts: str) -> Token:
        return self.take(*texts) or self._raise(" or ".join(texts))

    def _raise(self, wanted: str):
        raise self.fail(wanted)

    def word(self, wanted: str) -> str:
        if self.now.kind != "word":
            raise self.fail(wanted)
        self.at += 1
        return self.tokens[self.at - 1].text

    # -- statements
    def parse(self) -> Any:
        out = self.statement()
        self.take(";")
        if self.now.kind != "end":
            raise self.fail("the end")
        return out

    def statement(self) -> Any:
        if self.take("EXPLAIN"):
            return Explain(self.statement())
        if self.take("DATALOG"):
            if self.now.text != "SELECT":
                raise self.fail("SELECT")
        if self.take("SELECT"):
            return self.select()
        if self.take("UPSERT"):
            return self.upsert()
        if self.take("UPDATE"):
            alias = self.alias() if self.take("AS") else "d1"
            self.need("SET")
            sets = self.sets()
            self.need("WHERE")
            return Update(alias, sets, self.either())
        if self.take("DELETE"):
            self.need("WHERE")
            return Delete(self.either())
        if self.take("ATTRIBUTE"):
            name, kind = self.word("an attribute"), self.word("a type")
            many = unique = False
            while self.now.kind == "word":
                mark = self.word("ONE, MANY or UNIQUE").upper()
                if mark not in ("ONE", "MANY", "UNIQUE"):
                    raise SqlError(f"unknown {mark!r} in ATTRIBUTE")
                many, unique = many or mark == "MANY", unique or mark == "UNIQUE"
            return DeclareAttribute(name, kind.upper(), many, unique)
        if self.take("PARTITION"):
            return DeclarePartition(self.word("a name"))
        raise self.fail("a statement")

    def alias(self) -> str:
        return self.word("an alias").lower()

    def select(self) -> Select:
        out = Select([], history=bool(self.take("HISTORY")))
        if self.take("*"):
            out.star = True
        else:
            while True:
                start = self.now.at
                out.items.append(self.expression(fields=True))
                out.names.append(" ".join(self.sql[start : self.now.at].rstrip(" ,;\n\t").split()))
                if not self.take(","):
                    break
        if self.take("WHERE"):
            out.where = self.either()
        if self.take("GROUP"):
            self.need("BY")
            out.group = self.listed()
        if self.take("ORDER"):
            self.need("BY")
            while True:
                item = self.expression(fields=True)
                direction = self.take("ASC", "DESC")
                out.order.append((item, bool(direction and direction.text == "DESC")))
                if not self.take(","):
                    break
        if self.take("LIMIT"):
            out.limit = self.primary()
            if not isinstance(out.limit, Param) and not (isinstance(out.limit, Literal) and isinstance(out.limit.value, int)):
                raise self.fail("a whole number")
        return out

    def listed(self) -> list:
        out = [self.expression(fields=True)]
        while self.take(","):
            out.append(self.expression(fields=True))
        return out

    def upsert(self) -> Upsert:
        clauses: list[Clause] = []
        while True:
            if self.take("AS"):
                c = Clause(self.alias())
                if self.take("="):
                    c.entity = self.primary()
                if self.take("WHERE"):
                    c.where = self.either()
                if self.take("SET"):
                    c.sets = self.sets()
            else:
                self.need("SET")
                c = Clause("d1", sets=self.sets())
            clauses.append(c)
            if self.now.text == "AS":
                continue
            if not (self.now.text == "," and self.tokens[self.at + 1].text == "AS"):
                return Upsert(clauses)
            self.at += 1

    def sets(self) -> list[tuple[str, Any]]:
        out = []
        while True:
            name = self.word("an attribute")
            self.need("=")
            out.append((name, self.expression(fields=True)))
            following = self.tokens[self.at + 1] if self.now.text == "," else None
            if not following or following.text == "AS":
                return out
            self.at += 1

    # -- conditions
    def either(self) -> Any:
        parts = [self.both()]
        while self.take("OR"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Either(parts)

    def both(self) -> Any:
        parts = [self.compare()]
        while self.take("AND"):
            parts.append(self.compare())
        return parts[0] if len(parts) == 1 else Both(parts)

    def compare(self) -> Any:
        if self.take("NOT"):
            return Not(self.compare())
        at = self.at
        if self.take("("):
            try:
                inner = self.either()
                self.need(")")
            except SqlError:
                self.at = at  # a parenthesized value
            else:
                if not (self.now.kind == "op" and self.now.text in ("=", "!=", "<>", "<", "<=", ">", ">=", "+", "-", "*", "/")):
                    return inner
                self.at = at
        left = self.expression(fields=True)
        negated = bool(self.take("NOT"))
        if self.take("IN"):
            if self.now.text.upper() == "BITMAP" and isinstance(left, Field) and left.name == "eid" and not negated:
                return self.bitmap(left.alias)
            self.need("(")
            return Compare("not in" if negated else "in", left, self.values())
        if self.take("LIKE"):
            like = Compare("like", left, self.expression())
            return Not(like) if negated else like
        if self.take("BETWEEN"):
            low = self.expression(fields=True)
            self.need("AND")
            high = self.expression(fields=True)
            return Either([Compare("<", left, low), Compare(">", left, high)]) if negated else Both([Compare(">=", left, low), Compare("<=", left, high)])
        if negated:
            raise self.fail("IN, LIKE or BETWEEN")
        op = self.take("=", "!=", "<>", "<", "<=", ">", ">=")
        if not op:
            raise self.fail("a comparison")
        name = "!=" if op.text == "<>" else op.text
        at = self.at
        if self.take("("):
            if self.now.text == "SELECT":
                raise SqlError(f"subqueries aren't supported, at {self.now.at}")
            try:
                values = self.values()
            except SqlError:
                values = []
            if len(values) > 1:
                if name not in ("=", "!="):
                    raise SqlError(f"{name} doesn't take a list, at {op.at}")
                return Compare("in" if name == "=" else "not in", left, values)
            self.at = at
        right = self.expression(fields=True)
        if isinstance(right, Field) and not isinstance(left, Field):
            return Compare(FLIPPED[name], right, left)
        return Compare(name, left, right)

    def bitmap(self, alias: str) -> Both:
        """eid IN BITMAP(attr = value, ..): entities that have all of the facts."""
        self.at += 1
        self.need("(")
        parts = []
        while True:
            name = self.word("an attribute")
            self.need("=")
            parts.append(Compare("=", Field(alias, name), self.expression()))
            if not self.take(","):
                break
        self.need(")")
        return Both(parts)

    def values(self) -> list:
        out = [self.expression()]
        while self.take(","):
            out.append(self.expression())
        self.need(")")
        return out

    # -- expressions
    def expression(self, fields: bool = False) -> Any:
        out = self.product(fields)
        while op := self.take("+", "-"):
            out = Op(op.text, (out, self.product(fields)))
        return out

    def product(self, fields: bool) -> Any:
        out = self.unary(fields)
        while op := self.take("*", "/", "MOD"):
            out = Op(op.text.lower(), (out, self.unary(fields)))
        return out

    def unary(self, fields: bool) -> Any:
        if self.take("-"):
            inner = self.unary(fields)
            return Literal(-inner.value) if isinstance(inner, Literal) and isinstance(inner.value, int | float) else Op("neg", (inner,))
        if self.take("+"):
            return self.unary(fields)
        return self.primary(fields)

    def primary(self, fields: bool = False) -> Any:
        t = self.now
        if self.take("("):
            out = self.expression(fields)
            self.need(")")
            return out
        if self.take("TRUE", "FALSE"):
            return Literal(t.text == "TRUE")
        if t.kind in ("int", "float", "param", "str"):
            self.at += 1
            if t.kind == "str":
                return Literal(t.text[1:-1].replace("''", "'"))
            return Param(int(t.text[1:])) if t.kind == "param" else Literal(int(t.text) if t.kind == "int" else float(t.text))
        if self.take("CASE"):
            return self.case()
        if t.kind != "word":
            raise self.fail("a value")
        self.at += 1
        if self.now.text == "(" and t.text.lower() in SCALARS.keys() | AGGREGATES:
            return self.function(t.text.lower())
        if self.now.text == "(" and t.text.lower() not in ("eid", "val"):
            self.at += 1
            args = () if self.take(")") else tuple(self.listed())
            if args:
                self.need(")")
            return Op(f"call {t.text.lower()}", args)
        if t.text.lower() in ("eid", "val") and self.now.text == "(":
            self.at += 1
            args = [self.argument()]
            self.need(",")
            args.append(self.argument())
            self.need(")")
            return Call(t.text.lower(), tuple(args))
        return self.reference(t.text)

    def case(self) -> Case:
        whens = []
        while self.take("WHEN"):
            condition = self.either()
            self.need("THEN")
            whens.append((condition, self.expression(fields=True)))
        if not whens:
            raise self.fail("WHEN")
        self.need("ELSE")
        other = self.expression(fields=True)
        self.need("END")
        return Case(tuple(whens), other)

    def function(self, name: str) -> Any:
        self.need("(")
        if name == "count" and self.take("*"):
            self.need(")")
            return Aggregate("count")
        distinct = bool(self.take("DISTINCT"))
        args = self.listed()
        self.need(")")
        if name in AGGREGATES and (len(args) == 1 or name not in SCALARS or distinct):
            if len(args) > 1:
                raise SqlError(f"{name.upper()} takes one value")
            return Aggregate(name, args[0], distinct)
        return Op(SCALARS[name], tuple(args))

    def argument(self) -> Any:
        if self.now.kind == "word" and self.tokens[self.at + 1].text != "(" and not ALIAS.match(self.now.text):
            return Literal(self.word("an attribute"))
        return self.expression(fields=True)

    @staticmethod
    def reference(text: str) -> Field:
        head, _, rest = text.partition(".")
        if ALIAS.match(head) or head.lower() == "tx" and not rest:
            return Field(head.lower(), rest or "eid")
        return Field("d1", text)


def parse(sql: str) -> Any:
    return Parser(sql).parse()
