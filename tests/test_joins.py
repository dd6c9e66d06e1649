"""Joins on values that several rows of both sides hold, against counted pairs."""

from collections import Counter

import pytest

from factweave.operators import joins
from factweave.sources.star_schema import session


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(joins, "TASK", 200)
    monkeypatch.setattr(joins, "BLOCK", 8)


def sizes(df):
    return [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]


def test_value_join_is_dealt(spark, small):
    """One value with most rows, copies of a row, nulls, values of one side, zeros of both signs."""
    left = [(k, f"l{i % 90}") for i, k in enumerate([0.0, -0.0] * 100 + [1.0] * 3 + [2.0, float("nan"), None, 7.0])]
    right = [(f"r{i % 40}", k) for i, k in enumerate([0] * 150 + [1] * 2 + [2, None, 9])]
    found = joins.value_join(spark.createDataFrame(left, "k double, l string"), spark.createDataFrame(right, "r string, k2 long"), [("k", "k2")])
    assert found.columns == ["k", "l", "r", "k2"]
    want = Counter((str(k), x, y, j) for k, x in left for y, j in right if k is not None and k == j)
    assert want.total() == 200 * 150 + 7
    assert Counter((str(r["k"]), r["l"], r["r"], r["k2"]) for r in found.collect()) == want
    # 30,000 rows of one value, and none of the tasks has the larger part of them
    tasks = sizes(found)
    assert len(tasks) > 80 and max(tasks) < 1500, tasks


def test_value_joins_of_several_columns(spark, small):
    left = spark.range(3000).selectExpr("id % 3 as a", "cast(id % 2 as string) as b", "id as l")
    right = spark.range(200).selectExpr("cast(id % 3 as string) as a2", "id % 2 as b2", "id as r")
    found = joins.value_join(left, right, [("a", "a2"), ("b", "b2")])
    assert {(r["l"], r["r"]) for r in found.collect()} == {(x, y) for x in range(3000) for y in range(200) if x % 6 == y % 6}
    assert found.count() == 100_000 and max(sizes(found)) < 4000


def test_select_deals_value_joins_only(spark, sf_dir, small):
    text = "SELECT d1.customer.name, d2.customer.name WHERE d1.customer.nation = d2.customer.nation"
    found = session(spark, sf_dir).table(text).toDF("a", "b")
    nation = {r["c_name"]: r["c_nationkey"] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect()}
    assert Counter(map(tuple, found.collect())) == Counter((a, b) for a in nation for b in nation if nation[a] == nation[b])
    tasks = sizes(found)
    assert len(tasks) > 3 and max(tasks) < sum(tasks) / 2, tasks  # one without dealing
    plan = session(spark, sf_dir).explain("SELECT d1.customer.name, d2.order.total WHERE d1.eid = d2.order.customer")
    assert "Repartition" not in plan and "REPARTITION_BY_NUM" not in plan
