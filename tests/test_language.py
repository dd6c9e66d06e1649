"""Parsing, binding and conditions, without Spark."""

import pytest

from factweave.functions import ids
from factweave.functions.values import ValueType, coerce
from factweave.operators.ranges import Interval, condition, intervals, show
from factweave.plans import parser as p
from factweave.plans.ir import Var
from factweave.sources.catalog import BOOTSTRAP, Catalog, SchemaError


def one(text):
    return p.parse(text).items[0]


@pytest.mark.parametrize(
    ("text", "value"),
    [("20+20", ("+", 20, 20)), ("2+3*4", ("+", 2, ("*", 3, 4))), ("(1+2)*3", ("*", ("+", 1, 2), 3)), ("-7", -7), ("-(1+2)", ("neg", ("+", 1, 2))), ("7 MOD 3", ("mod", 7, 3)), ("1.5", 1.5), ("'it''s'", "it's"), ("true", True)],
)
def test_expressions(text, value):
    def tree(x):
        return x.value if isinstance(x, p.Literal) else (x.op, *map(tree, x.args))

    assert tree(one(f"SELECT {text}")) == value


def test_statements():
    s = p.parse("SELECT HISTORY d1.person.name, d1.tx WHERE d1.eid = %1 AND (d1.person.age > 5 OR d1.person.age = 1);")
    assert s.history and s.names == ["d1.person.name", "d1.tx"] and isinstance(s.where, p.Both)
    u = p.parse("UPSERT AS D1 SET company.name = %1, AS D2 = eid('a.b', 'x') SET person.employer = d1, AS TX SET tx.user = 'alice'")
    assert [c.alias for c in u.clauses] == ["d1", "d2", "tx"] and u.clauses[1].entity == p.Call("eid", (p.Literal("a.b"), p.Literal("x")))
    assert p.parse("ATTRIBUTE ns.a LONG MANY UNIQUE") == p.DeclareAttribute("ns.a", "LONG", True, True)
    assert isinstance(p.parse("EXPLAIN SELECT d1.a.b"), p.Explain) and isinstance(p.parse("DATALOG SELECT d1.a.b"), p.Select)
    assert p.parse("SELECT d1.a.b WHERE d1.a.b != (1, 2)").where.op == "not in"
    assert p.parse("SELECT a.b WHERE a.b = 1").where.left == p.Field("d1", "a.b")


@pytest.mark.parametrize("text", ["SELECT", "SELECT d1.a.b WHERE", "FOO", "SELECT d1.a.b WHERE d1.a.b > (1, 2)", "SELECT d1.a.b WHERE d1.a.b = (SELECT 1)", "SELECT 'x", "UPDATE SET a.b = 1", "SELECT 1 2"])
def test_syntax_errors(text):
    with pytest.raises(p.SqlError):
        p.parse(text)


def test_ids_and_catalog():
    e = ids.make_eid(64, 5)
    assert (ids.partition_of(e), ids.seq_of(e)) == (64, 5) and len(BOOTSTRAP) == 26
    c = Catalog()
    a, new = c.declare(":person/name", ValueType.STRING)
    assert new and a.name == "person.name" and c.declare("person.name", ValueType.STRING)[1] is False
    assert c.declare("person.name", ValueType.STRING, many=True)[1] and a.many
    for bad in (lambda: c.declare("person.name", ValueType.LONG), lambda: c.declare("name", ValueType.LONG), lambda: c.get("no.such")):
        with pytest.raises(SchemaError):
            bad()
    assert c.partition("mine") == 64 == c.partition("mine")


@pytest.mark.parametrize(("value", "kind", "out"), [(1, "BOOLEAN", True), (5, "FLOAT", 5.0), ("2024-01-01", "INSTANT", 1704067200000000), (b"\0", "BYTES", b"\0")])
def test_coercion(value, kind, out):
    assert coerce(value, ValueType[kind]) == out


@pytest.mark.parametrize(("value", "kind"), [("x", "LONG"), (1, "STRING"), (True, "LONG"), (2, "BOOLEAN"), (2**63, "LONG"), ("x" * (1 << 20) + "x", "STRING"), ("x", "BYTES")])
def test_type_errors(value, kind):
    with pytest.raises(TypeError):
        coerce(value, ValueType[kind])


@pytest.mark.parametrize(
    ("spec", "text"),
    [((">=", 10, "<=", 20), "[10, 20]"), (15, "{15}"), (("!=", 15), "(-inf, 15) U (15, +inf)"), ((">", 200, "<", 100), "empty"), (["or", ["=", 1], ["=", 20]], "{1} U {20}"), (["in", 3, 1], "{1} U {3}"), (["and", ["or", ["<", 5], [">", 7]], [">=", 4]], "[4, 5) U (7, +inf)"), (["or", [">", 1], ["<=", 1]], "(-inf, +inf)"), (["or", ["!=", 3], [">=", 3, "<=", 7]], "(-inf, +inf)")],
)
def test_intervals(spec, text):
    assert show(condition(Var("x"), spec)) == text


def test_interval_meet():
    assert Interval(1, 3).meet(Interval(3, 5)) == Interval(3, 3) and Interval(1, 3, hi_in=False).meet(Interval(3, 5)) is None
    assert intervals(condition(Var("x"), ["and"])) == [Interval()]
