"""Headline queries at one scale; prints one JSON line.

Each query runs once to warm up and then ``RUNS`` times over a table that is
already written; the median wall time of a full result (a ``noop`` write) counts.
Statements that change a table are timed from open to commit.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

REPO = Path(__file__).resolve().parent
sys.path.insert(0, str(REPO))
os.environ["PYTHONPATH"] = f"{REPO}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lakeloom import queries as q  # noqa: E402
from lakeloom.operators import dml  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("lakeloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="lakeloom-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def full(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(f, before=None) -> float:
    """Median seconds; ``before`` prepares each run and isn't counted."""
    took = []
    for k in range(RUNS + 1):
        given = before() if before else None
        t = time.perf_counter()
        f(given) if before else f()
        if k:
            took.append(time.perf_counter() - t)
    return round(statistics.median(took), 4)


def main() -> None:
    spark, d = session(), SF_DIR
    out: dict[str, float] = {}
    a, b = q.parts(q.raw(spark, d, "lineitem"), "l_orderkey", 2)
    lines = q.table_of(spark, a, "lineitem")
    lines.append(b)
    orders, part = q._batches(spark, d), q.raw(spark, d, "part")
    ranges = q._ranges(spark, d)
    days = q.table_of(spark, q.raw(spark, d, "events"), "events", [("ts", "day")])
    deleted = q._batches(spark, d)
    deleted.delete("o_orderstatus = 'F' AND o_totalprice > 50000", dml.MERGE_ON_READ)
    deleted.delete("o_custkey % 10 = 3", dml.MERGE_ON_READ, keys=["o_custkey"])

    revenue = q.REVENUE.replace("lineitem", "{lineitem}", 1).replace("JOIN part ", "JOIN {part} ")
    out["revenue_by_brand"] = timed(lambda: full(spark.sql(revenue, lineitem=lines.scan(), part=part)))
    out["top_customers"] = timed(lambda: full(orders.sql(q.TOP.replace("FROM orders", "FROM {orders}"), "orders")))
    out["scan_full_lineitem"] = timed(lambda: full(lines.scan()))
    out["scan_filter_projection"] = timed(lambda: full(orders.scan(["o_orderkey", "o_custkey"], "o_orderstatus = 'F' AND o_totalprice > 100000")))
    out["prune_minmax"] = timed(lambda: full(ranges.scan(condition="o_orderkey < 50")))
    out["prune_partition_day"] = timed(lambda: full(days.scan(condition="ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-12'")))
    out["time_travel"] = timed(lambda: full(orders.at_snapshot(orders.snapshot_ids()[0]).scan()))
    out["scan_with_deletes"] = timed(lambda: full(deleted.scan()))
    fresh = lambda: q._batches(spark, d)
    out["append_orders"] = timed(lambda t: t.append(q.raw(spark, d, "orders")), fresh)
    out["delete_cow"] = timed(lambda t: t.delete("o_orderstatus = 'F' AND o_totalprice > 50000"), fresh)
    out["delete_mor"] = timed(lambda t: t.delete("o_orderstatus = 'F' AND o_totalprice > 50000", dml.MERGE_ON_READ), fresh)
    out["update_cow"] = timed(lambda t: t.update("o_totalprice > 100000", {"o_orderstatus": "'X'"}), fresh)
    changed = q.raw(spark, d, "orders").where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("U"))
    out["upsert"] = timed(lambda t: t.upsert(changed, ["o_orderkey"]), fresh)
    out["compact_zorder"] = timed(lambda t: t.compact(strategy="zorder", columns=["o_custkey", "o_orderdate"]), fresh)
    out["row_changes"] = timed(lambda: full(orders.changes(orders.snapshot_ids()[0], keys=["o_orderkey"])))
    out["window_rank"] = timed(lambda: full(orders.sql("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM {orders}", "orders")))

    try:
        from lakeloom.llm import registry
    except ModuleNotFoundError:
        registry = None
    for name, query in registry.queries().items() if registry else ():
        full(query(spark, "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else d))
        t = time.perf_counter()
        full(query(spark, d))
        out[name] = round(time.perf_counter() - t, 4)
    print(json.dumps({"metric": "total of query medians", "value": round(sum(out.values()), 4), "unit": "sec", "queries": out, "sf": Path(d).name}))


if __name__ == "__main__":
    main()
