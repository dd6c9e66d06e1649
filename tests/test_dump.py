"""The sort of a dump: as a whole, in tasks of bounded rows."""

from factweave.operators import extensions
from factweave.sources import star_schema
from factweave.sources.star_schema import session


def test_large_dumps_are_sorted_in_bounded_tasks(spark, sf_dir, monkeypatch):
    s = session(spark, sf_dir)
    whole = s.dump("VAET")
    plain = [tuple(r) for r in whole.collect()]
    monkeypatch.setattr(extensions, "SORTED", 250)
    found = s.dump("VAET")
    assert [tuple(r) for r in found.collect()] == plain
    assert plain == sorted(plain, key=lambda r: (r[3], r[1], r[0], r[4])) and len(plain) > 20_000
    tasks = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(tasks) == len(plain) and max(tasks) < 1000, tasks
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("rangepartitioning") == 1, plan


def test_large_tables_are_keyed_in_bounded_tasks(spark, sf_dir, monkeypatch):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plain = star_schema.line_keys(lines)
    monkeypatch.setattr(star_schema, "KEYED", 100)
    found = star_schema.line_keys(lines)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    tasks = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(tasks) > 5000 and max(tasks) < 500, tasks
