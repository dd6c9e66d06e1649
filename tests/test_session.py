"""Facts written and read through sessions, against small expected results and a brute-force model."""

import random

import pytest

from factweave import admin
from factweave.cli import Shell
from factweave.plans.parser import SqlError
from factweave.session import Session, UniqueError
from factweave.sources.catalog import SchemaError


@pytest.fixture(scope="module")
def people(spark):
    s = Session(spark)
    for text in ("person.name STRING", "person.age LONG", "person.city STRING", "person.email STRING UNIQUE", "person.friend REF", "person.tags STRING MANY"):
        s.sql(f"ATTRIBUTE {text}")
    for name, age, city in (("Alice", 30, "SP"), ("Bob", 25, "SP"), ("Carol", 35, "RJ")):
        s.sql("UPSERT SET person.name = %1, person.age = %2, person.city = %3, person.email = %4", name, age, city, f"{name.lower()}@example.com")
    s.sql("UPDATE SET person.friend = eid('person.email', 'bob@example.com') WHERE d1.person.name = 'Alice'")
    return s


def test_select(people):
    assert people.sql("SELECT d1.person.name WHERE d1.person.age > 28 AND d1.person.city = 'SP'").rows() == [("Alice",)]
    assert people.sql("SELECT d2.person.name WHERE d1.person.friend = d2 AND d1.person.name = 'Alice'").rows() == [("Bob",)]
    assert people.sql1("SELECT 1 WHERE d1.person.age > 100") is None and people.sql1("SELECT 1 WHERE d1.person.age > 10") == (1,)
    assert len(people.sql("SELECT d1.person.name WHERE d1.person.age IN (25, 35) AND d1.person.age > 30").rows()) == 1
    assert people.sql("SELECT d1.person.name WHERE d1.person.email = 'alice@example.com'").rows() == [("Alice",)]
    assert people.sql1("SELECT 2+3*4, 7/2, 7 MOD 3, -7") == (14, 3.5, 1, -7)
    attrs = {r[0] for r in people.sql("SELECT d1.attr WHERE d1.person.name = 'Alice'").rows()}
    assert attrs == {"person.name", "person.age", "person.city", "person.email", "person.friend"}
    assert sum(len(b) for b in people.sql("SELECT d1.person.name").batches(2)) == 3


def test_errors(people):
    with pytest.raises(SqlError):
        people.sql("SELECT d2.person.name WHERE d1.person.age > 1")
    with pytest.raises(SqlError):
        people.sql("SELECT d1.person.name WHERE d1.person.age = %2", 1)
    with pytest.raises(SchemaError):
        people.sql("SELECT d1.person.nothing")
    with pytest.raises(SchemaError):
        people.lookup_entity("person.name", "Alice")
    with pytest.raises(UniqueError):
        people.sql("UPSERT SET person.email = 'bob@example.com'")
    with pytest.raises(TypeError):
        people.sql("SELECT d1.person.name WHERE d1.person.age > 'x'")
    with pytest.raises(ValueError):
        people.prepare(["?e"], [("?e", "person.age", "?a")])
    with pytest.raises(ValueError):
        people.prepare(["?e", "?b"], [("?e", "person.age", "?e")])
    assert people.sql("UPSERT AS D1 = eid('person.email', 'nobody') SET person.age = 1").rows() == []


def test_datalog(people):
    q = people.prepare(["?n", "?a"], [("?e", "person.name", "?n"), ("?e", "person.age", "?a")], ranges={"?a": (">=", 25, "<", 35)}, given={"?e": people.lookup_entity("person.email", "bob@example.com")})
    assert q.collect() == [("Bob", 25)] and q.first() == ("Bob", 25)
    names = people.prepare(["?n", "?e"], [("?e", "person.name", "?n")])
    assert [r[0] for r in names.collect(2)] == ["Alice", "Bob"] and "person.name" in names.explain()
    assert people.prepare(["?c"], [("_", "person.city", "?c")]).collect() == [("RJ",), ("SP",)]
    assert people.prepare(["?e"], [("?e", "person.friend", "?e")]).first() is None


def test_history_and_time(spark):
    clock = iter(range(10**6, 10**8, 10**6))
    s = Session(spark, clock=lambda: next(clock))
    s.sql("ATTRIBUTE company.name STRING")
    e = s.sql1("UPSERT SET company.name = 'old'")[0]
    t1 = s.sql1("SELECT d1.tx WHERE d1.company.name = 'old'")[0]
    at1 = s.lookup_value(t1, "db.txInstant")
    s.sql("UPSERT AS D1 = %1 SET company.name = 'new'", e)
    assert s.sql("SELECT d1.company.name").rows() == [("new",)]
    assert s.as_of(t1).sql("SELECT d1.company.name").rows() == [("old",)] == s.as_of(at1).sql("SELECT d1.company.name").rows()
    assert s.as_of(1).sql("SELECT d1.company.name").rows() == []
    assert sorted(s.sql("SELECT HISTORY d1.company.name WHERE d1.eid = %1", e).rows()) == [("new",), ("old",)]
    assert len(s.sql("SELECT HISTORY * WHERE d1.eid = %1", e).rows()) == 3
    s.sql("UPSERT AS D1 = %1 SET company.name = 'new'", e)
    assert s.sql("SELECT d1.company.name").rows() == [("new",)]
    assert s.sql("DELETE WHERE d1.eid = %1", e).rows() == [(e,)] and s.sql("SELECT d1.company.name").rows() == []
    s.sql("UPSERT SET company.name = 'x', AS TX SET company.name = 'annotated'")
    assert s.sql("SELECT d2.company.name WHERE d1.company.name = 'x' AND d1.tx = d2").rows() == [("annotated",)]


def test_persistence(spark, tmp_path):
    s = Session(spark, str(tmp_path / "log"))
    s.sql("ATTRIBUTE a.name STRING UNIQUE")
    s.sql("ATTRIBUTE a.tag LONG MANY")
    s.sql("PARTITION mine")
    e = s.sql1("UPSERT SET a.name = 'x', a.tag = 1, a.tag = 2")[0]
    assert s.commit() > 0 and s.commit() == 0
    again = Session(spark, str(tmp_path / "log"))
    assert sorted(again.sql("SELECT d1.a.tag WHERE d1.a.name = 'x'").rows()) == [(1,), (2,)]
    assert again.lookup_entity("a.name", "x") == e and again.catalog.get("a.tag").many and "mine" in again.catalog.partitions
    assert again.sql1("UPSERT SET a.name = 'y'")[0] > e
    assert admin.compact(again) > 0 and again.sql("SELECT d1.a.name").count == 2
    assert admin.status(again)["buffered"] == 0 and admin.tree(again).count() > 0
    old = admin.gc(again, dry=True)
    assert len(old) == 2 and admin.gc(again) == old and admin.gc(again) == []
    third = Session(spark, str(tmp_path / "log"))
    assert third.sql("SELECT d1.a.name").count == 2 and third.lookup_entity("a.name", "y") > e and admin.estimate(third, "a.tag") == 2
    third.kv.put(b"k", b"v"), third.commit()
    assert Session(spark, str(tmp_path / "log")).kv.get(b"k") == b"v"


def test_key_values_and_shell(people, tmp_path):
    kv = people.kv
    kv.put(b"a", b"1"), kv.put(b"b", b"2"), kv.put(b"a", b"3"), kv.delete(b"b")
    assert kv.get(b"a") == b"3" and kv.get(b"b") is None and kv.scan().count() == 1
    import io

    out = io.StringIO()
    Shell(people, out).loop(["SELECT d1.person.name\n", "WHERE d1.person.age = 25;\n", "SELECT nonsense;\n", ".schema\n", ".quit\n"])
    text = out.getvalue()
    assert "Bob" in text and "error:" in text and "person.tags" in text


def test_random_facts(spark):
    """Saves and retractions in random order against a list of datoms."""
    rng = random.Random(7)
    s = Session(spark)
    s.declare_attribute("r.one", "LONG"), s.declare_attribute("r.many", "LONG", many=True)
    model: dict[tuple, bool] = {}
    es = [s.alloc_entity() for _ in range(4)]
    for _ in range(12):
        with s.transaction():
            e, v = rng.choice(es), rng.randrange(4)
            name = rng.choice(["r.one", "r.many"])
            if rng.random() < 0.7:
                if name == "r.one":
                    for k in [k for k in model if k[:2] == (e, name)]:
                        model[k] = False
                model[e, name, v] = True
                s.save(e, name, v)
            else:
                model[e, name, v] = False
                s.retract(e, name, v)
    for name in ("r.one", "r.many"):
        assert sorted(s.sql(f"SELECT d1.eid, d1.{name}").rows()) == sorted((e, v) for (e, n, v), on in model.items() if on and n == name)
    both = s.sql("SELECT d1.r.one, d2.r.many WHERE d1.r.one = d2.r.many").rows()
    live = [k for k, on in model.items() if on]
    assert sorted(both) == sorted((a[2], b[2]) for a in live for b in live if a[1] == "r.one" and b[1] == "r.many" and a[2] == b[2])


def test_failing_update_leaves_nothing(spark):
    s = Session(spark)
    for text in ("p.name STRING", "p.email STRING UNIQUE"):
        s.sql(f"ATTRIBUTE {text}")
    s.sql("UPSERT AS D1 SET p.name = 'A', p.email = 'a', AS D2 SET p.name = 'B', p.email = 'b'")
    before = s.store.log().count()
    with pytest.raises(UniqueError):
        s.sql("UPDATE SET p.name = 'Z', p.email = 'same' WHERE d1.p.name != 'C'")
    assert s.store.log().count() == before and not s.store.staged
    assert sorted(s.sql("SELECT d1.p.name, d1.p.email").rows()) == [("A", "a"), ("B", "b")]
    s.sql("UPDATE SET p.name = 'Z' WHERE d1.p.email = 'b'")
    assert sorted(s.sql("SELECT d1.p.name").rows()) == [("A",), ("Z",)]
    # a bulk transaction's own instant is in its files
    assert s.store.files.where("a = 50 OR t IS NULL").count() >= 0 and not [k for k in s.store.buffer if k[2] == s.store.newest]
    assert s.store.files.select("t").distinct().count() == s.store.files.where(f"a = {s.catalog.get('db.txInstant').aid}").count()


def test_uncommitted_segments_are_not_read(spark, tmp_path):
    path = str(tmp_path / "log")
    s = Session(spark, path)
    s.sql("ATTRIBUTE a.n LONG")
    s.sql("UPSERT SET a.n = 1")
    s.commit()
    s.store.files.write.partitionBy("a").parquet(f"{path}/seg=99999999-torn")  # a write that died before its commit
    again = Session(spark, path)
    assert again.sql("SELECT d1.a.n").rows() == [(1,)] and admin.gc(again) == ["99999999-torn"]


def test_many_upserts(spark):
    """5,000 statements with a unique attribute, and commits between them."""
    import time

    s = Session(spark)
    s.sql("ATTRIBUTE u.key STRING UNIQUE"), s.sql("ATTRIBUTE u.n LONG")
    start = time.perf_counter()
    for k in range(5000):
        s.sql("UPSERT SET u.key = %1, u.n = %2", f"k{k}", k)
        if k % 2000 == 1999:
            s.commit()
    assert time.perf_counter() - start < 60
    with pytest.raises(UniqueError):
        s.sql("UPSERT SET u.key = 'k17'")
    s.sql("UPSERT AS D1 = eid('u.key', 'k17') SET u.n = -1")
    assert s.sql("SELECT d1.u.n WHERE d1.u.key = 'k17'").rows() == [(-1,)] and s.sql("SELECT d1.u.key").count == 5000
    s.store.index.most = 10  # beyond its bound the index gives up and the log answers
    s.sql("UPSERT SET u.key = 'new', u.n = 0")
    assert not s.store.index.values and s.lookup_entity("u.key", "k17") is not None and s.lookup_entity("u.key", "none") is None


def test_larger_dialect(people):
    rows = lambda text, *p: people.sql(text, *p).rows()
    assert rows("SELECT d1.person.name WHERE d1.person.name LIKE 'A%' ") == [("Alice",)]
    assert rows("SELECT d1.person.name WHERE d1.person.name NOT LIKE '%o%'") == [("Alice",)]
    assert sorted(rows("SELECT d1.person.name WHERE d1.person.age BETWEEN 25 AND %1", 30)) == [("Alice",), ("Bob",)]
    assert rows("SELECT d1.person.name WHERE d1.person.age NOT BETWEEN 25 AND 30") == [("Carol",)]
    assert rows("SELECT d1.person.name WHERE d1.person.age NOT IN (25, 30)") == [("Carol",)]
    assert rows("SELECT d1.person.name WHERE NOT (d1.person.age < 35 OR d1.person.city = 'SP')") == [("Carol",)]
    assert rows("SELECT d1.person.name ORDER BY d1.person.age DESC LIMIT 2") == [("Carol",), ("Alice",)]
    assert rows("SELECT d1.person.city, COUNT(*), SUM(d1.person.age), MAX(d1.person.age) GROUP BY d1.person.city ORDER BY 1") == [("RJ", 1, 35, 35), ("SP", 2, 55, 30)]
    assert rows("SELECT d1.person.city ORDER BY COUNT(*) DESC, 1") == [("SP",), ("RJ",)]
    assert rows("SELECT COUNT(DISTINCT d1.person.city), AVG(d1.person.age)") == [(2, 30.0)]
    assert rows("SELECT UPPER(d1.person.name), ABS(25 - d1.person.age), MAX(d1.person.age, 31), CASE WHEN d1.person.age > 30 THEN 'old' ELSE 'young' END WHERE d1.person.city = 'RJ'") == [("CAROL", 10, 35, "old")]
    assert sorted(rows("SELECT d1.person.name WHERE d1.eid IN BITMAP(person.city = 'SP', person.age = 30)")) == [("Alice",)]
    from pyspark.sql import functions as F

    people.register("twice", lambda c: c * 2)
    assert rows("SELECT TWICE(d1.person.age) WHERE d1.person.name = 'Bob'") == [(50,)]
    people.register("shout", F.udf(lambda x: x + "!", "string"))
    assert rows("SELECT SHOUT(d1.person.name) WHERE d1.person.name = 'Bob'") == [("Bob!",)]
    for bad in ("SELECT NOTHING(1)", "SELECT d1.person.name GROUP BY d1.person.age", "SELECT d1.person.name ORDER BY 3", "SELECT d1.person.name LIMIT 'x'", "SELECT d1.person.name WHERE d1.person.name LIKE d1.person.city"):
        with pytest.raises(SqlError):
            people.sql(bad)


def test_loader_merges(spark, tmp_path):
    import zipfile

    from factweave.sources.loader import load, read_zipped

    for name, lines in (("a", ["01;Matriz;10,20", "02;Filial;", ";none;1"]), ("b", ["03;São;30", "01;00000000;40"])):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("rows.csv", "\n".join(lines).encode("latin-1"))
    s = Session(spark)
    for text in ("kind.code STRING UNIQUE", "kind.label STRING", "firm.code STRING UNIQUE", "firm.label STRING", "firm.tags LONG MANY", "firm.kind REF"):
        s.sql(f"ATTRIBUTE {text}")
    kinds = spark.createDataFrame([("01", "x"), ("02", "y")], "code string, label string")
    load(s, kinds, ("code", "kind.code"), {"label": "kind.label"})
    rows = read_zipped(spark, str(tmp_path / "a.zip"), ["code", "label", "tags"]).selectExpr("*", "case when code = '01' then '02' else '09' end as kind")
    load(s, rows, ("code", "firm.code"), {"label": "firm.label", "tags": "firm.tags", "kind": "firm.kind"}, {"kind": "kind.code"}, lists=("tags",))
    first = s.lookup_entity("firm.code", "01")
    more = read_zipped(spark, str(tmp_path / "b.zip"), ["code", "label", "tags"])
    load(s, more, ("code", "firm.code"), {"label": "firm.label", "tags": "firm.tags"}, lists=("tags",))
    assert sorted(s.sql("SELECT d1.firm.code, d1.firm.label").rows()) == [("01", "Matriz"), ("02", "Filial"), ("03", "São")]
    assert s.lookup_entity("firm.code", "01") == first
    assert sorted(s.sql("SELECT d1.firm.code, d1.firm.tags").rows()) == [("01", 10), ("01", 20), ("01", 40), ("03", 30)]
    assert s.sql("SELECT d2.kind.label WHERE d1.firm.kind = d2 AND d1.firm.code = '01'").rows() == [("y",)]


def test_delimited_text(spark, tmp_path):
    from factweave.sources.loader import read_delimited

    (tmp_path / "rows.csv").write_bytes('"01";"São; Paulo"\n"02";""\n'.encode("latin-1"))
    rows = read_delimited(spark, str(tmp_path / "rows.csv"), ["code", "name"]).collect()
    assert [(r["code"], r["name"] or "") for r in rows] == [("01", "São; Paulo"), ("02", "")]


def test_shown_ranges():
    from factweave.operators.ranges import show
    from factweave.plans.ir import Const, In, Var

    assert show(In(Var("x"), [Const(1), Const(2)])) == "{1} U {2}"
    assert show(In(Var("x"), [Const(1), Const(2)], negated=True)) == "(-inf, 1) U (1, 2) U (2, +inf)"


def test_transaction_annotation_and_limits(people):
    t = people.sql1("UPSERT SET person.name = 'Dora', AS TX SET person.city = 'noted'")[0]
    assert people.sql("SELECT d2.person.city WHERE d1.person.name = 'Dora' AND d1.tx = d2").rows() == [("noted",)]
    assert len(people.sql("SELECT d1.person.name", limit=2).rows()) == 2
    people.sql("DELETE WHERE d1.eid = %1", t)
    assert people.sql("SELECT d1.person.name WHERE d1.person.name = 'Dora'").rows() == []
