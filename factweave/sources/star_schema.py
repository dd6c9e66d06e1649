"""The sample tables as facts: a namespace, an id partition and a key for each."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import SHIFT, TX, eid_column
from ..functions.values import ValueType as V
from ..operators.extensions import tasks_of

# namespace: table, partition, key, {attribute: (column, type, partition of the referenced entity)}
TABLES: dict[str, tuple] = {
    "region": ("region", 64, "r_regionkey", {"name": ("r_name", V.STRING, None)}),
    "nation": ("nation", 65, "n_nationkey", {"name": ("n_name", V.STRING, None), "region": ("n_regionkey", V.REF, 64)}),
    "customer": ("customer", 66, "c_custkey", {"name": ("c_name", V.STRING, None), "acctbal": ("c_acctbal", V.FLOAT, None), "segment": ("c_mktsegment", V.STRING, None), "nation": ("c_nationkey", V.REF, 65)}),
    "supplier": ("supplier", 67, "s_suppkey", {"name": ("s_name", V.STRING, None), "acctbal": ("s_acctbal", V.FLOAT, None), "nation": ("s_nationkey", V.REF, 65)}),
    "part": ("part", 68, "p_partkey", {"name": ("p_name", V.STRING, None), "brand": ("p_brand", V.STRING, None), "type": ("p_type", V.STRING, None), "size": ("p_size", V.LONG, None), "price": ("p_retailprice", V.FLOAT, None)}),
    "order": ("orders", 69, "o_orderkey", {"status": ("o_orderstatus", V.STRING, None), "total": ("o_totalprice", V.FLOAT, None), "date": ("o_orderdate", V.INSTANT, None), "priority": ("o_orderpriority", V.STRING, None), "customer": ("o_custkey", V.REF, 66)}),
    "item": ("lineitem", 70, None, {"number": ("l_linenumber", V.LONG, None), "qty": ("l_quantity", V.FLOAT, None), "price": ("l_extendedprice", V.FLOAT, None), "discount": ("l_discount", V.FLOAT, None), "tax": ("l_tax", V.FLOAT, None), "returnflag": ("l_returnflag", V.STRING, None), "linestatus": ("l_linestatus", V.STRING, None), "shipdate": ("l_shipdate", V.INSTANT, None), "order": ("l_orderkey", V.REF, 69), "part": ("l_partkey", V.REF, 68), "supplier": ("l_suppkey", V.REF, 67)}),
    "event": ("events", 71, "event_id", {"ts": ("ts", V.INSTANT, None), "type": ("event_type", V.STRING, None), "value": ("value", V.FLOAT, None), "props": ("props", V.STRING, None), "user": ("user_id", V.REF, 77)}),
    "doc": ("documents", 72, "doc_id", {"text": ("text", V.STRING, None), "lang": ("lang", V.STRING, None), "source": ("source", V.STRING, None), "n_chars": ("n_chars", V.LONG, None)}),
    "label": ("labels", 72, "doc_id", {"quality": ("quality", V.LONG, None), "toxic": ("toxic", V.LONG, None)}),
    "page": ("pages", 73, "page_id", {"url": ("url", V.STRING, None), "html": ("html", V.STRING, None)}),
    "bench": ("benchmark", 74, "item_id", {"text": ("text", V.STRING, None)}),
}
UNIQUE = {"region.name", "nation.name", "customer.name", "supplier.name"}
FIRST_EVENT_TX = (TX << SHIFT) + 1


LINES = 1 << 6
KEYED = 1 << 18


def line_keys(df: DataFrame) -> DataFrame:
    """A key for lineitem, which has none: the order's key and the line's place among its order's
    lines, in the order of all columns. Dealt by order, so nothing is sorted as a whole, and of a large
    table to so many tasks that each sorts about KEYED lines; the count reads footers only."""
    if n := tasks_of(df, df.count(), KEYED):
        df = df.repartition(n, "l_orderkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*[c for c in df.columns if c != "l_orderkey"])) - 1
    full = F.raise_error(F.lit(f"an order of more than {LINES} lines")).cast("long")
    return df.withColumn("_key", F.when(place < LINES, F.col("l_orderkey") * LINES + place).otherwise(full))


EXPRESSIONS: dict[Any, dict] = {}


def expressions(spark: SparkSession) -> dict[str, dict]:
    """{namespace: {attribute: (expression, type)}}; they don't depend on the data, so they are made
    once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app not in EXPRESSIONS:
        EXPRESSIONS.clear()
        EXPRESSIONS[app] = {ns: {} for ns in TABLES}
        for ns, (*_, attrs) in TABLES.items():
            for a, (column, kind, target) in attrs.items():
                value = F.col(column)
                EXPRESSIONS[app][ns][f"{ns}.{a}"] = (eid_column(target, value) if target else value.cast("long") if kind == V.LONG else value.cast("timestamp") if kind == V.INSTANT else value, kind)
    return EXPRESSIONS[app]


def session(spark: SparkSession, sf_dir: str) -> Any:
    """A session over the sample tables."""
    from ..session import Session

    s = Session(spark)
    frames: dict[str, DataFrame] = {}

    def frame(name: str) -> DataFrame:
        if name not in frames:
            frames[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return frames[name]

    for ns, columns in expressions(spark).items():
        name, part, key, _ = TABLES[ns]
        s.map_table(lambda name=name: frame(name), part, columns, key=key, keyed=None if key else line_keys, unique=UNIQUE)
    last = s.declare_attribute("user.last_event", "STRING")
    s.store.attach(last, lambda: last_events(frame("events")), 77)
    instant = s.catalog.get("db.txInstant")
    s.store.attach(instant, lambda: frame("events").select(tx_of_event().alias("e"), F.col("ts").cast("timestamp").alias("v"), tx_of_event().alias("t"), F.lit(True).alias("added")), TX)
    last.retracted = True
    return s


def tx_of_event() -> Any:
    return F.col("event_id") + F.lit(FIRST_EVENT_TX)


def last_events(events: DataFrame) -> DataFrame:
    """Each event asserts its type for its user and retracts the one before, if it differs."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = events.select(eid_column(77, F.col("user_id")).alias("e"), F.col("event_type").alias("v"), F.lag("event_type").over(w).alias("before"), tx_of_event().alias("t"))
    now = F.struct(F.col("v"), F.lit(True).alias("added"))
    then = F.struct(F.col("before").alias("v"), F.lit(False).alias("added"))
    facts = F.when(F.col("before") != F.col("v"), F.array(now, then)).otherwise(F.array(now))
    return rows.select("e", "t", F.explode(facts).alias("f")).select("e", "f.v", "t", "f.added")
