"""Times of the headline queries: median of 3 warm runs each, written to the no-op sink.

--compare [name ..]: a table instead, of the headlines or the named queries: one scan for each pattern
(naive), this engine, and its SQL in DuckDB; the faster of two warm runs each, rows, and file scans in
this engine's plan."""

import json
import os
import statistics
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = "q04_star_attrs q05_range_open q14_ref_join q15_reverse_ref_join q16_chain3 q17_chain_star_mix q18_value_join q22_wildcard_attr q27_current_last_event q28_asof_tx q30_history_values q31_tx_join q35_datalog_join q37_datalog_distinct q42_item_multi_ref q46_group_count q50_rank_window q54_event_windows".split()


def started():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from factweave.queries import QUERIES

    spark = started()
    times: dict[str, float] = {}
    for name in HEADLINES:
        took = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "total of median query seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    sys.stdout.flush()


def compare() -> None:
    import duckdb

    from factweave import queries

    spark, con = started(), duckdb.connect()
    con.execute(f"SET threads = {CPUS}")
    for t in "region nation customer supplier part orders lineitem events documents labels pages benchmark conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    mapped = queries.session

    def naive(*args):
        s = mapped(*args)
        s.coalesce = False
        return s

    def timed(run) -> float:
        took = []
        for _ in range(3):
            start = time.perf_counter()
            run()
            took.append(time.perf_counter() - start)
        return min(took[1:])

    def engine(name: str) -> None:
        queries.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    print("query | naive_s | engine_s | duckdb_s | rows | file scans in plan")
    print("|".join(["-"] * 6))
    for name in sys.argv[2:] or HEADLINES:
        sql = queries.ORACLES[name]
        queries.session = naive
        slow = timed(lambda: engine(name))  # noqa: B023
        queries.session = mapped
        fast = timed(lambda: engine(name))  # noqa: B023
        duck = timed(lambda: con.execute(sql).fetchall())  # noqa: B023
        df = queries.QUERIES[name](spark, SF_DIR)
        print(f"{name} | {slow:.2f} | {fast:.2f} | {duck:.3f} | {len(con.execute(sql).fetchall())} | {df._jdf.queryExecution().executedPlan().toString().count('FileScan parquet')}", flush=True)


if __name__ == "__main__":
    compare() if "--compare" in sys.argv else main()
