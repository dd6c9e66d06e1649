"""A query for each capability, and the SQL that gives its result on the original tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ids import SHIFT, make_eid
from .functions.values import ValueType
from .operators import extensions as ext
from .session import Session, UniqueError
from .sources.loader import load, pivoted, shred
from .sources.kv import latest
from .sources.star_schema import FIRST_EVENT_TX, LINES, session
from .sources.store import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MID_TX = FIRST_EVENT_TX + 500
MID_TIME = "2024-01-10 00:00:00"


def eid(partition: int, key: str) -> str:
    return f"(CAST({partition} AS BIGINT) * {1 << SHIFT} + {key})"


def select(name: str, columns: str, text: str, *params, oracle: str) -> None:
    """Register a SELECT; columns are the names of its result."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return session(spark, sf_dir).table(text, *params).toDF(*columns.split())

    query.__name__ = name
    QUERIES[name], ORACLES[name] = query, oracle


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


select("q01_attr_scan", "name", "SELECT d1.customer.name", oracle="SELECT c_name AS name FROM customer")
select("q02_eid_point", "name acctbal", "SELECT d1.customer.name, d1.customer.acctbal WHERE d1.eid = %1", make_eid(66, 7), oracle="SELECT c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_custkey = 7")
select("q03_unique_lookup", "eid", "SELECT d1.eid WHERE d1.region.name = 'ASIA'", oracle=f"SELECT {eid(64, 'r_regionkey')} AS eid FROM region WHERE r_name = 'ASIA'")
select("q04_star_attrs", "name acctbal segment", "SELECT d1.customer.name, d1.customer.acctbal, d1.customer.segment", oracle="SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer")
select("q05_range_open", "eid total", "SELECT d1.eid, d1.order.total WHERE d1.order.total > %1", 250000, oracle=f"SELECT {eid(69, 'o_orderkey')} AS eid, o_totalprice AS total FROM orders WHERE o_totalprice > 250000")
select("q06_range_closed", "eid total", "SELECT d1.eid, d1.order.total WHERE d1.order.total >= 100000 AND d1.order.total <= 150000", oracle=f"SELECT {eid(69, 'o_orderkey')} AS eid, o_totalprice AS total FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000")
select("q07_not_equal", "eid status", "SELECT d1.eid, d1.order.status WHERE d1.order.status != 'F'", oracle=f"SELECT {eid(69, 'o_orderkey')} AS eid, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F'")
select("q08_range_neq", "eid size", "SELECT d1.eid, d1.part.size WHERE d1.part.size > 10 AND d1.part.size <> 20", oracle=f"SELECT {eid(68, 'p_partkey')} AS eid, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size > 10 AND p_size <> 20")
select("q09_in_list", "eid segment", "SELECT d1.eid, d1.customer.segment WHERE d1.customer.segment IN ('BUILDING', %1)", "MACHINERY", oracle=f"SELECT {eid(66, 'c_custkey')} AS eid, c_mktsegment AS segment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
select("q10_eq_list", "eid size", "SELECT d1.eid, d1.part.size WHERE d1.part.size = (1, 5, 9)", oracle=f"SELECT {eid(68, 'p_partkey')} AS eid, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size IN (1, 5, 9)")
select("q11_or_same_field", "eid size", "SELECT d1.eid, d1.part.size WHERE (d1.part.size < 5 OR d1.part.size > 45)", oracle=f"SELECT {eid(68, 'p_partkey')} AS eid, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size < 5 OR p_size > 45")
select("q12_in_and_range", "eid size", "SELECT d1.eid, d1.part.size WHERE d1.part.size IN (1, 6, 9) AND d1.part.size > 5", oracle=f"SELECT {eid(68, 'p_partkey')} AS eid, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size IN (1, 6, 9) AND p_size > 5")
select("q13_eid_range", "eid name", "SELECT d1.eid, d1.customer.name WHERE d1.eid >= %1 AND d1.eid < %2", make_eid(66, 20), make_eid(66, 60), oracle=f"SELECT {eid(66, 'c_custkey')} AS eid, c_name AS name FROM customer WHERE c_custkey >= 20 AND c_custkey < 60")
select("q14_ref_join", "customer nation", "SELECT d1.customer.name, d2.nation.name WHERE d1.customer.nation = d2", oracle="SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
select("q15_reverse_ref_join", "name total", "SELECT d1.customer.name, d2.order.total WHERE d1.eid = d2.order.customer", oracle="SELECT c_name AS name, o_totalprice AS total FROM customer JOIN orders ON o_custkey = c_custkey")
select("q16_chain3", "customer nation region", "SELECT d1.customer.name, d2.nation.name, d3.region.name WHERE d1.customer.nation = d2.eid AND d2.nation.region = d3.eid", oracle="SELECT c_name AS customer, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
FLAGSHIP = """SELECT d1.customer.name, d2.nation.name, d4.order.total
WHERE d1.customer.nation = d2 AND d2.nation.region = d3 AND d3.region.name = 'ASIA' AND d4.order.customer = d1 AND d4.order.total > 300000"""
select("q17_chain_star_mix", "customer nation total", FLAGSHIP, oracle="SELECT c_name AS customer, n_name AS nation, o_totalprice AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA' AND o_totalprice > 300000")
select("q18_value_join", "supplier customer", "SELECT d1.supplier.name, d2.customer.name WHERE d1.supplier.nation = d2.customer.nation AND d2.customer.acctbal > 9000", oracle="SELECT s_name AS supplier, c_name AS customer FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal > 9000")
select("q19_entity_unify", "name acctbal", "SELECT d1.customer.name, d2.customer.acctbal WHERE d1.eid = d2.eid", oracle="SELECT c_name AS name, c_acctbal AS acctbal FROM customer")
select("q20_self_ref", "eid", "SELECT d1.eid WHERE d1.event.user = d1.eid", oracle=f"SELECT {eid(71, 'event_id')} AS eid FROM events WHERE false")
select("q21_exists_true", "one", "SELECT 1 WHERE d1.order.total > 1000", oracle="SELECT 1 AS one WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000)")
select("q21_exists_false", "one", "SELECT 1 WHERE d1.order.total < %1", -1, oracle="SELECT 1 AS one WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice < -1)")
select("q22_wildcard_attr", "attr", "SELECT d1.attr WHERE d1.eid = %1", make_eid(66, 7), oracle="SELECT unnest(['customer.name', 'customer.acctbal', 'customer.segment', 'customer.nation']) AS attr")
select("q23_wildcard_attr_val", "attr val", "SELECT d1.attr, d1.val WHERE d1.eid = %1", make_eid(65, 3), oracle=f"SELECT 'nation.name' AS attr, n_name AS val FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'nation.region', CAST({eid(64, 'n_regionkey')} AS VARCHAR) FROM nation WHERE n_nationkey = 3")
select("q24_select_star", "eid attr val", "SELECT * WHERE d1.region.name = 'ASIA'", oracle=f"SELECT {eid(64, 'r_regionkey')} AS eid, 'region.name' AS attr, r_name AS val FROM region WHERE r_name = 'ASIA'")
select("q25_literal_expr", "a b c d e f", "SELECT 2+3*4, (1+2)*3, -7, 7 MOD 3, 7/2, -(1+2)", oracle="SELECT 14::INT AS a, 9::INT AS b, -7::INT AS c, 1::INT AS d, 3.5::DOUBLE AS e, -3::INT AS f")
select("q26_expr_in_where", "eid size", "SELECT d1.eid, d1.part.size WHERE d1.part.size = %1 + 10", 5, oracle=f"SELECT {eid(68, 'p_partkey')} AS eid, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size = 15")
select("q27_current_last_event", "user last", "SELECT d1.eid, d1.user.last_event", oracle=f'SELECT {eid(77, "user_id")} AS "user", arg_max(event_type, event_id) AS "last" FROM events GROUP BY user_id')


def at(s: Session, when) -> DataFrame:
    return s.as_of(when).table("SELECT d1.eid, d1.user.last_event").toDF("user", "last")


@query(f'SELECT {eid(77, "user_id")} AS "user", arg_max(event_type, event_id) AS "last" FROM events WHERE event_id <= 500 GROUP BY user_id')
def q28_asof_tx(spark, sf_dir):
    return at(session(spark, sf_dir), MID_TX)


@query(f"SELECT {eid(77, 'user_id')} AS \"user\", arg_max(event_type, event_id) AS \"last\" FROM events WHERE ts <= TIMESTAMP '{MID_TIME}' GROUP BY user_id")
def q29_asof_instant(spark, sf_dir):
    return at(session(spark, sf_dir), MID_TIME)


CHANGES = f"""SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, {FIRST_EVENT_TX} + event_id AS tx FROM events"""
select("q30_history_values", "last tx added", "SELECT HISTORY d1.user.last_event, d1.tx, d1.added", oracle=f'WITH c AS ({CHANGES}) SELECT event_type AS "last", tx, true AS added FROM c UNION ALL SELECT before, tx, false FROM c WHERE before <> event_type')
select("q31_tx_join", "last at", "SELECT d1.user.last_event, d2.db.txInstant WHERE d1.tx = d2", oracle='SELECT arg_max(event_type, event_id) AS "last", max_by(ts, event_id)::TIMESTAMP AS "at" FROM events GROUP BY user_id')
select("q32_same_tx", "user last at", "SELECT d1.eid, d1.user.last_event, d2.db.txInstant WHERE d1.tx = d2.tx", oracle=f'SELECT {eid(77, "user_id")} AS "user", arg_max(event_type, event_id) AS "last", max_by(ts, event_id)::TIMESTAMP AS "at" FROM events GROUP BY user_id')
select("q33_history_star", "eid attr val tx added", "SELECT HISTORY * WHERE d1.eid = %1", make_eid(77, 5), oracle=f"WITH c AS ({CHANGES}) SELECT {eid(77, 'user_id')} AS eid, 'user.last_event' AS attr, event_type AS val, tx, true AS added FROM c WHERE user_id = 5 UNION ALL SELECT {eid(77, 'user_id')}, 'user.last_event', before, tx, false FROM c WHERE before <> event_type AND user_id = 5")
select("q34_sparse_inner", "eid lang quality toxic", "SELECT d1.eid, d1.doc.lang, d1.label.quality, d1.label.toxic", oracle=f"SELECT {eid(72, 'doc_id')} AS eid, lang, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM documents JOIN labels USING (doc_id)")


@query("SELECT c_name AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q35_datalog_join(spark, sf_dir):
    s = session(spark, sf_dir)
    found = s.prepare(["?c", "?n", "?x", "?y"], [("?x", "customer.name", "?c"), ("?x", "customer.nation", "?y"), ("?y", "nation.name", "?n")])
    return found.df().select("c", "n")


@query(f"SELECT {eid(68, 'p_partkey')} AS e, CAST(p_size AS BIGINT) AS s FROM part WHERE (p_size < 5 OR (p_size >= 20 AND p_size < 30)) AND p_size <> 3")
def q36_datalog_range_tree(spark, sf_dir):
    tree = ["and", ["or", ["<", 5], [">=", 20, "<", 30]], ["!=", 3]]
    return session(spark, sf_dir).prepare(["?e", "?s"], [("?e", "part.size", "?s")], ranges={"?s": tree}).df()


@query("SELECT DISTINCT p_brand AS b FROM part")
def q37_datalog_distinct(spark, sf_dir):
    return session(spark, sf_dir).prepare(["?b"], [("_", "part.brand", "?b")]).df()


@query("SELECT c_name AS c FROM customer WHERE c_nationkey = 3")
def q38_datalog_given(spark, sf_dir):
    found = session(spark, sf_dir).prepare(["?e", "?c"], [("?e", "customer.name", "?c"), ("?e", "customer.nation", "?n")], given={"?n": make_eid(65, 3)})
    return found.df().select("c")


@query(f"SELECT p_brand AS b, {eid(68, 'p_partkey')} AS e FROM part ORDER BY 1, 2 LIMIT 10")
def q39_datalog_collect_limit(spark, sf_dir):
    return session(spark, sf_dir).prepare(["?b", "?e"], [("?e", "part.brand", "?b")]).ordered().limit(10)


def people(spark: SparkSession) -> Session:
    s = Session(spark, clock=lambda: 1_700_000_000_000_000)
    for text in ("person.name STRING", "person.age LONG", "person.email STRING UNIQUE", "person.friend REF", "person.tag STRING MANY"):
        s.sql(f"ATTRIBUTE {text}")
    s.sql("UPSERT AS D1 SET person.name = 'Alice', person.age = 30, person.email = 'alice@example.com', AS D2 SET person.name = 'Bob', person.age = 25, person.email = 'bob@example.com', person.friend = d1")
    return s


@query("SELECT * FROM (VALUES ('Alice', 31::BIGINT), ('Cara', 40::BIGINT)) t(name, age)")
def q40_upsert_update_delete(spark, sf_dir):
    s = people(spark)
    s.sql("UPSERT SET person.name = 'Carol', person.age = 40, person.email = 'c@example.com'")
    s.sql("UPSERT AS D1 = eid('person.email', 'c@example.com') SET person.name = 'Cara'")
    s.sql("UPDATE SET person.age = 31 WHERE d1.person.age >= 30 AND d1.person.age < 35")
    s.sql("DELETE WHERE d1.person.name = 'Bob' AND d1.person.age > 0")
    return s.table("SELECT d1.person.name, d1.person.age").toDF("name", "age")


@query("SELECT * FROM (VALUES ('Dan', 30::BIGINT, 'Alice')) t(name, age, friend)")
def q41_unique_eid_val(spark, sf_dir):
    s = people(spark)
    s.sql("UPSERT SET person.name = 'Dan', person.friend = eid(person.email, %1), person.age = val(eid('person.email', %1), 'person.age')", "alice@example.com")
    return s.table("SELECT d1.person.name, d1.person.age, d2.person.name WHERE d1.person.friend = d2 AND d1.person.name = 'Dan'").toDF("name", "age", "friend")


select("q42_item_multi_ref", "qty customer part supplier", "SELECT d1.item.qty, d3.customer.name, d4.part.name, d5.supplier.name WHERE d1.item.order = d2 AND d2.order.customer = d3 AND d1.item.part = d4 AND d1.item.supplier = d5 AND d1.item.qty > 45", oracle="SELECT l_quantity AS qty, c_name AS customer, p_name AS part, s_name AS supplier FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 45")


@query("SELECT unnest(['person.tag']) AS ident")
def q43_schema_introspection(spark, sf_dir):
    return people(spark).table("SELECT d1.db.ident WHERE d1.db.cardinality = 36").toDF("ident")


REFS = [("region", "nation", 65, "n_nationkey", 64, "n_regionkey", "nation"), ("nation", "customer", 66, "c_custkey", 65, "c_nationkey", "customer"), ("nation", "supplier", 67, "s_suppkey", 65, "s_nationkey", "supplier"), ("customer", "order", 69, "o_orderkey", 66, "o_custkey", "orders"), ("user", "event", 71, "event_id", 77, "user_id", "events"), ("order", "item", 70, "k", 69, "l_orderkey", "items"), ("part", "item", 70, "k", 68, "l_partkey", "items"), ("supplier", "item", 70, "k", 67, "l_suppkey", "items")]
ITEMS = f"items AS (SELECT *, l_orderkey * {LINES} + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS k FROM lineitem)"


@query(f"WITH {ITEMS} " + " UNION ALL ".join(f"SELECT {eid(p, key)} AS e, '{ns}.{a}' AS attr, CAST({eid(to, c)} AS VARCHAR) AS val FROM {t}" for a, ns, p, key, to, c, t in REFS))
def q44_dump_index(spark, sf_dir):
    """All references of all tables, lineitem's among them, by the reverse index; without the schema's own."""
    return session(spark, sf_dir).dump("VAET").where("attr not like 'db.%'").select("e", "attr", "val")


@query("SELECT c_custkey AS e, c_name AS \"name\", c_mktsegment AS segment FROM customer")
def q45_shred_roundtrip(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    facts = shred(customer, "c_custkey", {"c_name": "name", "c_mktsegment": "segment"})
    return pivoted(facts, ["name", "segment"])


@query("SELECT n_name AS nation, count(*) AS n, avg(c_acctbal) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def q46_group_count(spark, sf_dir):
    df = QUERIES["q14_ref_join"](spark, sf_dir)
    balance = session(spark, sf_dir).table("SELECT d1.customer.name, d1.customer.acctbal").toDF("customer", "acctbal")
    return ext.grouped(df.join(balance, "customer"), ["nation"], n=F.count("*"), balance=F.avg("acctbal"))


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY CUBE (1, 2)")
def q47_cube(spark, sf_dir):
    df = session(spark, sf_dir).table("SELECT d1.order.priority, d1.order.status").toDF("priority", "status")
    return ext.cubed(df, ["priority", "status"], n=F.count("*"))


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ROLLUP (1, 2)")
def q48_rollup_distinct(spark, sf_dir):
    df = session(spark, sf_dir).table("SELECT d1.order.priority, d1.order.status, d1.order.customer").toDF("priority", "status", "customer")
    return ext.rolled_up(df, ["priority", "status"], n=F.count_distinct("customer"))


@query(f"SELECT {eid(69, 'o_orderkey')} AS eid, o_totalprice AS total FROM orders ORDER BY 2 DESC, 1 LIMIT 20")
def q49_top_k(spark, sf_dir):
    df = session(spark, sf_dir).table("SELECT d1.eid, d1.order.total").toDF("eid", "total")
    return ext.top(df, 20, F.desc("total"), F.asc("eid"))


@query("SELECT * FROM (SELECT c_name AS customer, o_orderkey AS k, o_totalprice AS total, row_number() OVER (PARTITION BY c_name ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rank <= 3")
def q50_rank_window(spark, sf_dir):
    df = session(spark, sf_dir).table("SELECT d2.customer.name, d1.eid, d1.order.total WHERE d1.order.customer = d2").toDF("customer", "eid", "total")
    return ext.top_in_group(df, 3, ["customer"], F.desc("total"), F.asc("eid")).withColumn("k", F.col("eid").bitwiseAND(F.lit((1 << SHIFT) - 1))).drop("eid").withColumn("rank", F.col("rank").cast("long"))


@query(f"(SELECT {eid(65, 'c_nationkey')} AS nation FROM customer EXCEPT SELECT {eid(65, 's_nationkey')} FROM supplier) UNION ALL (SELECT {eid(65, 'c_nationkey')} FROM customer INTERSECT SELECT {eid(65, 's_nationkey')} FROM supplier WHERE s_acctbal > 5000)")
def q51_set_operations(spark, sf_dir):
    s = session(spark, sf_dir)
    c, p, rich = (s.table(t).toDF("nation") for t in ("SELECT d1.customer.nation", "SELECT d1.supplier.nation", "SELECT d1.supplier.nation WHERE d1.supplier.acctbal > 5000"))
    return c.subtract(p).unionAll(c.intersect(rich))


@query("SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def q52_anti_join(spark, sf_dir):
    s = session(spark, sf_dir)
    orders = s.table("SELECT d1.order.customer WHERE d1.order.total > 100000").toDF("e")
    return ext.without(s.table("SELECT d1.eid, d1.customer.name").toDF("e", "name"), orders, ["e"]).select("name")


@query("SELECT doc_id, lang, quality::BIGINT AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def q53_outer_join(spark, sf_dir):
    s = session(spark, sf_dir)
    rows = ext.optional(s.table("SELECT d1.eid, d1.doc.lang").toDF("e", "lang"), s.table("SELECT d1.eid, d1.label.quality").toDF("e", "quality"), ["e"])
    return rows.select(F.col("e").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("doc_id"), "lang", "quality")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type AS type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def q54_event_windows(spark, sf_dir):
    from .streaming.replica import windowed

    df = session(spark, sf_dir).table("SELECT d1.event.ts, d1.event.type, d1.event.value").toDF("ts", "type", "value")
    return windowed(df, "ts", "1 hour", "1 day", ["type"], n=F.count("*"), total=F.sum("value")).select(F.unix_micros(F.col("window.start").cast("timestamp")).alias("start"), "type", "n", "total")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 86400000000 THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id AS "user", session::BIGINT AS session, count(*) AS n FROM s GROUP BY 1, 2""")
def q55_sessionize(spark, sf_dir):
    df = session(spark, sf_dir).table("SELECT d1.event.user, d1.event.ts").toDF("eid", "ts")
    rows = ext.sessions(df, "eid", "ts", 86_400).withColumn("user", F.col("eid").bitwiseAND(F.lit((1 << SHIFT) - 1)))
    return rows.groupBy("user", "session").agg(F.count("*").alias("n"))


@query(f'SELECT {eid(77, "user_id")} AS e, arg_max(event_type, event_id) AS "last" FROM events GROUP BY user_id')
def q56_stream_replica(spark, sf_dir):
    """The log of a temporal attribute written to files, followed by a stream, reduced to its state."""
    import uuid

    from .functions.values import COLUMNS
    from .sources.star_schema import last_events
    from .streaming.replica import Replica

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log = last_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    log.select("e", *[(F.col("v") if c == "v_str" else F.lit(None).cast(t)).alias(c) for c, t in COLUMNS.items()], "t", "added", F.lit(1).alias("a")).write.partitionBy("a").parquet(f"{base}/log")
    replica = Replica(spark, f"{base}/log", f"{base}/replica")
    replica.follow(f"{base}/checkpoint").awaitTermination()
    return replica.current().select("e", F.col("v_str").alias("last"))


@query("SELECT c_name AS \"name\" FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_name IS NOT NULL AND c_acctbal > 0")
def q57_facets(spark, sf_dir):
    s = session(spark, sf_dir)
    found = ext.having([s.table(t).toDF("e") for t in ("SELECT d1.eid WHERE d1.customer.segment = 'BUILDING'", "SELECT d1.eid WHERE d1.customer.acctbal > 0")])
    return s.table("SELECT d1.eid, d1.customer.name").toDF("e", "name").join(found, "e", "left_semi").select("name")


@query(f"SELECT {eid(77, 'user_id')} AS e, arg_max(event_type, event_id) AS v FROM events GROUP BY user_id")
def q58_save_many(spark, sf_dir):
    """Bulk assertion in two commits: the second replaces what differs."""
    s = Session(spark)
    s.declare_attribute("user.type", ValueType.STRING)
    events = session(spark, sf_dir).table("SELECT d1.event.user, d1.event.type, d1.eid").toDF("e", "v", "at")
    cut = make_eid(71, 400)
    for part in (events.where(F.col("at") < cut), events):
        s.save_many("user.type", part.groupBy("e").agg(F.max_by("v", "at").alias("v")))
    return s.table("SELECT d1.eid, d1.user.type").toDF("e", "v")


# ---- wildcards, bound patterns, self references ---------------------------------------------------

select("q59_attr_equals", "eid val", "SELECT d1.eid, d1.val WHERE d1.attr = 'customer.segment'", oracle=f"SELECT {eid(66, 'c_custkey')} AS eid, c_mktsegment AS val FROM customer")
select("q60_val_equals", "eid attr", "SELECT d1.eid, d1.attr WHERE d1.val = 'BUILDING'", oracle=f"SELECT {eid(66, 'c_custkey')} AS eid, 'customer.segment' AS attr FROM customer WHERE c_mktsegment = 'BUILDING'")
select("q61_value_is_wildcard", "name eid attr", "SELECT d1.nation.name, d2.eid, d2.attr WHERE d1.nation.name = d2.val", oracle=f"SELECT n_name AS name, {eid(65, 'n_nationkey')} AS eid, 'nation.name' AS attr FROM nation UNION ALL SELECT n_name, {eid(66, 'c_custkey')}, 'customer.name' FROM nation JOIN customer ON c_name = n_name")
select("q62_star_of_joined", "eid attr val", "SELECT d2.eid, d2.attr, d2.val WHERE d1.nation.name > 'A' AND d1.eid = d2.supplier.nation AND d2.supplier.acctbal > 0", oracle=f"""WITH s AS (SELECT {eid(67, 's_suppkey')} AS eid, s_name, CAST({eid(65, 's_nationkey')} AS VARCHAR) AS nation, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name > 'A' AND s_acctbal > 0)
SELECT eid, 'supplier.name' AS attr, s_name AS val FROM s UNION ALL SELECT eid, 'supplier.nation', nation FROM s UNION ALL SELECT eid, 'supplier.acctbal', CAST(s_acctbal AS VARCHAR) FROM s""")
select("q63_bound_probe", "name", "SELECT d1.region.name WHERE d2.eid = %1 AND d2.nation.region = %2 AND d1.region.name != 'ASIA'", make_eid(65, 0), make_eid(64, 0), oracle="SELECT r_name AS name FROM region WHERE r_name <> 'ASIA' AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 0 AND n_regionkey = 0)")
select("q64_unconnected", "a b", "SELECT d1.region.name, d2.nation.name WHERE d1.region.name != d2.nation.name AND d1.region.name < 'B'", oracle="SELECT r_name AS a, n_name AS b FROM region, nation WHERE r_name <> n_name AND r_name < 'B'")


@query(f"SELECT {eid(66, 'c_custkey')} AS e FROM customer WHERE c_custkey % 3 = 0")
def q65_self_reference(spark, sf_dir):
    """References of each customer to one of the next lower thousandth, some of them its own."""
    s = Session(spark)
    s.declare_attribute("customer.leader", ValueType.REF)
    rows = session(spark, sf_dir).table("SELECT d1.eid, d1.customer.name").toDF("e", "name")
    s.save_many("customer.leader", rows.select("e", (F.col("e") - F.col("e").bitwiseAND(F.lit((1 << SHIFT) - 1)) % 3).alias("v")))
    return s.table("SELECT d1.eid WHERE d1.customer.leader = d1.eid").toDF("e")


# ---- the larger dialect -------------------------------------------------------------------------

select("q66_like_between_not", "eid type size", "SELECT d1.eid, d1.part.type, d1.part.size WHERE d1.part.size BETWEEN 10 AND %1 AND d1.part.type LIKE '%A%' AND NOT (d1.part.size = 15 OR d1.part.brand IN ('Brand#11'))", 30, oracle=f"SELECT {eid(68, 'p_partkey')} AS eid, p_type AS type, p_size::BIGINT AS size FROM part WHERE p_size BETWEEN 10 AND 30 AND p_type LIKE '%A%' AND NOT (p_size = 15 OR p_brand IN ('Brand#11'))")
select("q67_not_in_not_like", "eid priority", "SELECT d1.eid, d1.order.priority WHERE d1.order.priority NOT LIKE '%LOW' AND d1.order.status NOT IN ('F', 'P')", oracle=f"SELECT {eid(69, 'o_orderkey')} AS eid, o_orderpriority AS priority FROM orders WHERE o_orderpriority NOT LIKE '%LOW' AND o_orderstatus NOT IN ('F', 'P')")
select("q68_group_by", "nation n total least", "SELECT d2.nation.name, COUNT(*), SUM(d1.customer.acctbal), MIN(d1.customer.acctbal) WHERE d1.customer.nation = d2 GROUP BY d2.nation.name", oracle="SELECT n_name AS nation, count(*) AS n, sum(c_acctbal) AS total, min(c_acctbal) AS least FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
select("q69_order_limit", "eid total", "SELECT d1.eid, d1.order.total WHERE d1.order.status = 'O' ORDER BY d1.order.total DESC, d1.eid LIMIT 25", oracle=f"SELECT {eid(69, 'o_orderkey')} AS eid, o_totalprice AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY 2 DESC, 1 LIMIT 25")
select("q70_scalars", "eid a b c d", "SELECT d1.eid, MAX(d1.part.size, 10), ABS(20 - d1.part.size), UPPER(d1.part.brand), CASE WHEN d1.part.size > 40 THEN 'large' WHEN d1.part.size > 20 THEN 'middle' ELSE 'small' END", oracle=f"SELECT {eid(68, 'p_partkey')} AS eid, greatest(p_size, 10)::BIGINT AS a, abs(20 - p_size)::BIGINT AS b, upper(p_brand) AS c, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'middle' ELSE 'small' END AS d FROM part")
select("q71_bitmap_facets", "name", "SELECT d1.customer.name WHERE d1.eid IN BITMAP(customer.segment = 'BUILDING', customer.nation = %1)", make_eid(65, 3), oracle="SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")


@query(f"SELECT {eid(69, 'o_orderkey')} AS eid, o_totalprice AS total FROM orders ORDER BY 2, 1 LIMIT 7")
def q72_sql_limit(spark, sf_dir):
    return session(spark, sf_dir).sql("SELECT d1.eid, d1.order.total ORDER BY d1.order.total, d1.eid", limit=7).df.toDF("eid", "total")


@query("SELECT p_brand AS brand, (p_size * 2 + 1)::BIGINT AS twice FROM part WHERE p_size < 10")
def q73_registered_function(spark, sf_dir):
    s = session(spark, sf_dir)
    s.register("twice", lambda size: size * 2 + 1)
    return s.table("SELECT d1.part.brand, TWICE(d1.part.size) WHERE d1.part.size < 10").toDF("brand", "twice")


@query("SELECT doc_id, coalesce(quality > 0 AND n_chars > quality, false) AS chained, quality IS NOT NULL AS labelled, CASE WHEN coalesce(toxic = 1, false) THEN 'toxic' ELSE lang END AS what FROM documents LEFT JOIN labels USING (doc_id)")
def q74_truth(spark, sf_dir):
    from .functions import scalar

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    chained = scalar.every(scalar.chain(">", F.col("n_chars"), F.col("quality"), F.lit(0)))
    return rows.select("doc_id", chained.alias("chained"), scalar.truthy(F.col("quality")).alias("labelled"), scalar.choose(F.col("toxic") == 1, F.lit("toxic"), F.col("lang")).alias("what"))


# ---- writes over tables -------------------------------------------------------------------------


@query(f"""SELECT {eid(66, 'c_custkey')} AS e, CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE c_mktsegment END AS segment, CASE WHEN c_acctbal < 0 THEN 'owes' END AS note
FROM customer WHERE c_mktsegment <> 'MACHINERY' OR c_acctbal < 0""")
def q75_bulk_update_delete(spark, sf_dir):
    """An UPDATE of two attributes, one that fails and leaves nothing, and a DELETE."""
    s = Session(spark)
    for name, kind, unique in (("c.segment", "STRING", False), ("c.balance", "FLOAT", False), ("c.note", "STRING", False), ("c.tag", "STRING", True)):
        s.declare_attribute(name, kind, unique=unique)
    rows = session(spark, sf_dir).table("SELECT d1.eid, d1.customer.segment, d1.customer.acctbal").toDF("e", "segment", "balance")
    with s.transaction():
        s.save_many("c.segment", rows.select("e", F.col("segment").alias("v")))
        s.save_many("c.balance", rows.select("e", F.col("balance").alias("v")))
    s.sql("UPDATE SET c.segment = 'debtor', c.note = 'owes' WHERE d1.c.balance < 0")
    try:
        s.sql("UPDATE SET c.segment = 'lost', c.tag = 'same' WHERE d1.c.balance > 0")
    except UniqueError:
        pass
    s.sql("DELETE WHERE d1.c.segment = 'MACHINERY'")
    return ext.optional(s.table("SELECT d1.eid, d1.c.segment").toDF("e", "segment"), s.table("SELECT d1.eid, d1.c.note").toDF("e", "note"), ["e"])


@query('SELECT c_name AS "name", n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey')
def q76_loader_with_codes(spark, sf_dir):
    """Two tables loaded with keys of their own, one referring to the other by its code."""
    s = Session(spark)
    for text in ("n.code LONG UNIQUE", "n.name STRING", "c.code LONG UNIQUE", "c.name STRING", "c.nation REF"):
        s.sql(f"ATTRIBUTE {text}")
    nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    load(s, nation, ("n_nationkey", "n.code"), {"n_name": "n.name"})
    load(s, customer, ("c_custkey", "c.code"), {"c_name": "c.name", "c_nationkey": "c.nation"}, {"c_nationkey": "n.code"})
    return s.table("SELECT d1.c.name, d2.n.name WHERE d1.c.nation = d2").toDF("name", "nation")


@query("SELECT user_id::VARCHAR AS \"user\", arg_max(event_type, event_id) AS \"last\" FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'view'")
def q77_key_values(spark, sf_dir):
    """A keyed log with tombstones: a view removes its user's pair."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_type") != "view", F.col("event_type").cast("binary"))
    log = events.select(F.col("user_id").cast("string").cast("binary").alias("key"), value.alias("value"), F.col("event_id").alias("version"))
    return latest(log).select(F.col("key").cast("string").alias("user"), F.col("value").cast("string").alias("last"))


# ---- streams ------------------------------------------------------------------------------------


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, event_type AS type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")
def q78_stream_windows(spark, sf_dir):
    """Daily windows kept up to date by a stream with a watermark, several files a batch."""
    import uuid

    from .streaming.replica import Windows

    base = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(4, "ts").write.parquet(f"{base}/events")
    kept = Windows(spark, f"{base}/windows", "ts", "1 day", "1 day", ["event_type"], n=F.count("*"), top=F.max("value"))
    kept.follow(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/events"), f"{base}/checkpoint").awaitTermination()
    return kept.current().select(F.unix_micros("start").alias("start"), F.col("event_type").alias("type"), "n", "top")


@query("""WITH c AS (SELECT user_id, event_type, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id AS "user", event_id, before, event_type AS now FROM c WHERE before IS NULL OR before <> event_type""")
def q79_stream_changes(spark, sf_dir):
    """What changes for each user as events stream in: the last value of each is kept as state."""
    import uuid

    from .streaming.replica import changes

    base = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    events.write.parquet(f"{base}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{base}/events")
    out = changes(stream, "user_id", "event_id", "event_type")
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out").select(F.col("key").alias("user"), F.col("at").alias("event_id"), "before", "now")
