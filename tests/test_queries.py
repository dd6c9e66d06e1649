"""Every engine query against its SQL, and the plans of some."""

import duckdb
import pytest

from factweave.queries import ORACLES, QUERIES
from factweave.sources.star_schema import session

TABLES = "region nation customer supplier part orders lineitem events documents labels pages benchmark conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def normal(rows):
    def cell(x):
        if isinstance(x, float):
            return f"{x:.9g}"
        return x.replace(tzinfo=None).isoformat() if hasattr(x, "isoformat") else str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", [*QUERIES])
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert normal([tuple(r[i] for i in at) for r in found.fetchall()]) == normal([tuple(r[c] for c in columns) for r in df.collect()])


def test_star_is_one_scan(spark, sf_dir):
    s = session(spark, sf_dir)
    plan = s.explain("SELECT d1.customer.name, d1.customer.acctbal, d1.customer.segment WHERE d1.customer.acctbal > 10")
    assert plan.count("Scan parquet") == 2  # once in the tree, once in the details
    assert "PushedFilters: [IsNotNull" in plan and "GreaterThan(c_acctbal,10.0)" in plan
    s.coalesce = False
    text = "SELECT d1.customer.name, d1.customer.acctbal"
    assert sorted(s.sql(text).rows()) == sorted(session(spark, sf_dir).sql(text).rows())


def test_wildcards_scan_each_table_once(spark, sf_dir):
    """A star behind a table's attribute reads that table alone, and no sort has one task."""
    s = session(spark, sf_dir)
    for text, scans in (("SELECT * WHERE d1.region.name = 'ASIA'", 4), ("SELECT d1.attr WHERE d1.eid = %1", 1)):
        plan = s.table(text, *[66 << 44 | 7][: text.count("%1")])._jdf.queryExecution().executedPlan().toString()
        # two of the first are the events' own temporal attributes, whose entities could be any
        assert plan.count("FileScan parquet") == scans and "lineitem" not in plan and "SinglePartition" not in plan, plan
    plan = s.dump("VAET")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 6 and "SinglePartition" not in plan


def test_entity_range_reaches_the_scan(spark, sf_dir):
    plan = session(spark, sf_dir).table("SELECT d1.customer.name WHERE d1.eid = %1", 66 << 44 | 7)._jdf.queryExecution().toString()
    assert "EqualTo(c_custkey,7)" in plan
