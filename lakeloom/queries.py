"""Queries over engine tables, each with the same result as DuckDB SQL over the raw files.

Every query builds its table in a working folder, does what its name says and
returns a lazy DataFrame.  ``QUERIES`` and ``ORACLES`` have the same keys but
for results that SQL over the raw files cannot express.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import CommitConflict
from .operators import dml, maintenance
from .plans.schema import Schema, simple
from .sources.storage import working_folder
from .session import read_table, write_table
from .sources.catalog import FileCatalog
from .sql import SqlSession
from .streaming.sink import append_batch, write_stream
from .streaming.source import stream_changes
from .table import Table, create_table, open_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def table_of(spark: SparkSession, df: DataFrame, what: str, partition_by: list | None = None, append: bool = True, identifiers: list[str] = (), properties: dict | None = None) -> Table:
    schema = Schema.of(df.schema, identifiers, required=())
    t = create_table(spark, working_folder(spark, what), schema, partition_by=partition_by, properties=properties)
    if append:
        t.append(df)
    return t


def parts(df: DataFrame, key: str, n: int) -> list[DataFrame]:
    return [df.where(F.col(key) % n == k) for k in range(n)]


# --- scans and appends -----------------------------------------------------------
@query("SELECT * FROM orders")
def scan_full(s, d):
    return table_of(s, raw(s, d, "orders"), "scan").scan()


@query("SELECT o_orderkey, o_totalprice FROM orders")
def scan_projection(s, d):
    return table_of(s, raw(s, d, "orders"), "scan").scan(["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def scan_filter(s, d):
    return table_of(s, raw(s, d, "orders"), "scan").scan(["o_orderkey", "o_custkey"], "o_orderstatus = 'F' AND o_totalprice > 100000")


REVENUE = """
SELECT p_brand, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue, CAST(count(*) AS BIGINT) AS units
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY revenue DESC, p_brand
"""


@query(REVENUE)
def append_two_snapshots_revenue_by_brand(s, d):
    a, b = parts(raw(s, d, "lineitem"), "l_orderkey", 2)
    lines = table_of(s, a, "lineitem")
    lines.append(b)
    return s.sql(REVENUE.replace("lineitem", "{lineitem}", 1).replace("JOIN part ", "JOIN {part} "), lineitem=lines.scan(), part=raw(s, d, "part"))


TOP = "SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS spent, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey ORDER BY spent DESC, o_custkey LIMIT 5"


@query(TOP)
def top_customers(s, d):
    return table_of(s, raw(s, d, "orders"), "orders").sql(TOP.replace("FROM orders", "FROM {orders}"), "orders")


# --- time travel -----------------------------------------------------------------
def _batches(s, d) -> Table:
    first, *rest = parts(raw(s, d, "orders"), "o_orderkey", 3)
    t = table_of(s, first, "orders")
    for r in rest:
        t.append(r)
    return t


@query("SELECT * FROM orders WHERE o_orderkey % 3 < 2")
def time_travel_snapshot(s, d):
    t = _batches(s, d)
    return t.at_snapshot(t.snapshot_ids()[1]).scan()


@query("SELECT * FROM orders WHERE o_orderkey % 3 = 0")
def time_travel_timestamp(s, d):
    t = _batches(s, d)
    return t.as_of(t.metadata.snapshots[1].timestamp_ms - 1).scan()


@query("SELECT * FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 3 = 2")
def rollback(s, d):
    first, middle, last = parts(raw(s, d, "orders"), "o_orderkey", 3)
    t = table_of(s, first, "orders")
    t.append(middle)
    t.rollback_to(t.snapshot_ids()[0])
    t.append(last)
    return open_table(s, t.location).scan()


@query("SELECT CAST(1 AS BIGINT) AS snapshot_id, 'append' AS operation, count(*) AS total_records FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 2, 'append', count(*) FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT 3, 'append', count(*) FROM orders")
def history(s, d):
    return _batches(s, d).history().select("snapshot_id", "operation", "total_records")


@query("SELECT 'data' AS content, CAST(count(*) AS BIGINT) AS records, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders")
def files_summary(s, d):
    f = _batches(s, d).files()
    return f.groupBy("content").agg(F.sum("record_count").alias("records"), F.min(F.col("lower")[1].cast("long")).alias("low"), F.max(F.col("upper")[1].cast("long")).alias("high"))


# --- pruning and hidden partitions -----------------------------------------------
def _ranges(s, d) -> Table:
    """Orders in four appends by key range, so bounds tell files apart."""
    o = raw(s, d, "orders")
    t = table_of(s, o, "orders", append=False)
    top = o.agg(F.max("o_orderkey")).first()[0]
    for k in range(4):
        t.append(o.where((F.col("o_orderkey") > top * k // 4 - (k == 0)) & (F.col("o_orderkey") <= top * (k + 1) // 4)))
    return t


def _pruned(t: Table, condition) -> DataFrame:
    if not len(t.plan(condition)) < len(t.plan()):
        raise AssertionError("no file was pruned")
    return t.scan(condition=condition)


@query("SELECT * FROM orders WHERE o_orderkey < 50")
def prune_minmax(s, d):
    return _pruned(_ranges(s, d), "o_orderkey < 50")


@query("SELECT * FROM orders WHERE o_orderkey IN (3, 5, 8)")
def prune_in(s, d):
    return _pruned(_ranges(s, d), [("o_orderkey", "in", [3, 5, 8])])


def _pruned_sql(t: Table, sql: str) -> DataFrame:
    df = t.sql(sql, "t")
    if not 0 < len(df.inputFiles()) < len(t.plan()):
        raise AssertionError("no file was pruned")
    return df


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderkey < 50 AND o_totalprice > 1000")
def sql_prune_minmax(s, d):
    return _pruned_sql(_ranges(s, d), "SELECT o_orderkey, o_totalprice * 2 AS twice FROM (SELECT * FROM {t}) x WHERE o_orderkey < 50 AND o_totalprice > 1000")


@query("SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' AND event_type <> 'error'")
def sql_prune_partition(s, d):
    t = table_of(s, raw(s, d, "events"), "events", [("ts", "day")])
    return _pruned_sql(t, "SELECT * FROM {t} WHERE ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-12' AND event_type <> 'error'")


@query("SELECT a.o_orderkey, b.o_totalprice FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IN (3, 5, 8) OR a.o_orderkey = 9")
def sql_prune_join(s, d):
    return _pruned_sql(_ranges(s, d), "SELECT a.o_orderkey, b.o_totalprice FROM {t} a JOIN {t} b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IN (3, 5, 8) OR a.o_orderkey = 9")


@query("SELECT * FROM orders WHERE o_orderkey < 20 OR o_orderkey = 33")
def prune_column(s, d):
    return _pruned(_ranges(s, d), (F.col("o_orderkey") < 20) | (F.col("o_orderkey") == 33))


@query("SELECT * FROM events WHERE event_type LIKE 'cl%'")
def prune_prefix(s, d):
    return _pruned(table_of(s, raw(s, d, "events"), "events", ["event_type"]), "event_type LIKE 'cl%'")


@query("SELECT * FROM orders WHERE o_custkey IN (34, 35, 36)")
def partition_bucket_in(s, d):
    t = table_of(s, raw(s, d, "orders"), "orders", [("o_custkey", "bucket[16]")])
    return _pruned(t, [("o_custkey", "in", [34, 35, 36])])


@query("SELECT * FROM part WHERE p_size = 5")
def partition_void(s, d):
    t = table_of(s, raw(s, d, "part"), "part", [("p_brand", "void")])
    return t.scan(condition="p_size = 5")


@query("SELECT * FROM orders WHERE o_custkey = 77")
def prune_bloom(s, d):
    o = raw(s, d, "orders")
    t = table_of(s, o, "orders", properties={"write.bloom.ndv.o_custkey": "20000"})
    return t.scan(condition="o_custkey = 77")


@query("SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def partition_day_events(s, d):
    t = table_of(s, raw(s, d, "events"), "events", [("ts", "day")])
    return _pruned(t, "ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-12'")


@query("SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-10 09:00:00'")
def partition_hour_events(s, d):
    t = table_of(s, raw(s, d, "events"), "events", [("ts", "hour")])
    return _pruned(t, "ts >= TIMESTAMP_NTZ '2024-01-10 06:00:00' AND ts < TIMESTAMP_NTZ '2024-01-10 09:00:00'")


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-05-01'")
def partition_month_orders(s, d):
    t = table_of(s, raw(s, d, "orders"), "orders", [("o_orderdate", "month")])
    return _pruned(t, [("o_orderdate", ">=", dt.datetime(1996, 3, 1)), ("o_orderdate", "<", dt.datetime(1996, 5, 1))])


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def partition_year_orders(s, d):
    t = table_of(s, raw(s, d, "orders"), "orders", [("o_orderdate", "year")])
    return _pruned(t, [("o_orderdate", ">=", dt.datetime(1996, 1, 1)), ("o_orderdate", "<", dt.datetime(1997, 1, 1))])


@query("SELECT * FROM orders WHERE o_custkey = 34")
def partition_bucket(s, d):
    t = table_of(s, raw(s, d, "orders"), "orders", [("o_custkey", "bucket[16]")])
    return _pruned(t, "o_custkey = 34")


@query("SELECT * FROM part WHERE p_brand = 'Brand#12'")
def partition_truncate(s, d):
    t = table_of(s, raw(s, d, "part"), "part", [("p_brand", "truncate[7]")])
    return t.scan(condition="p_brand = 'Brand#12'")


@query("SELECT * FROM events WHERE event_type = 'click'")
def partition_identity(s, d):
    return table_of(s, raw(s, d, "events"), "events", ["event_type"]).scan(condition="event_type = 'click'")


@query("SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND user_id = 7")
def partition_spec_evolution(s, d):
    a, b = parts(raw(s, d, "events"), "event_id", 2)
    t = table_of(s, a, "events", [("ts", "day")])
    t.set_spec(t.new_spec().bucket("user_id", 8).build())
    t.append(b)
    return _pruned(t, "ts >= TIMESTAMP_NTZ '2024-01-15' AND user_id = 7")


# --- row-level changes -----------------------------------------------------------
@query("SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 50000)")
def delete_cow(s, d):
    t = _batches(s, d)
    t.delete("o_orderstatus = 'F' AND o_totalprice > 50000")
    return t.scan()


@query("SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 50000)")
def delete_mor_position(s, d):
    t = _batches(s, d)
    t.delete("o_orderstatus = 'F' AND o_totalprice > 50000", dml.MERGE_ON_READ)
    return t.scan()


@query("SELECT * FROM orders WHERE o_orderkey % 3 < 2 AND o_custkey % 10 <> 3 UNION ALL SELECT * FROM orders WHERE o_orderkey % 3 = 2")
def delete_mor_equality(s, d):
    first, second, later = parts(raw(s, d, "orders"), "o_orderkey", 3)
    t = table_of(s, first, "orders")
    t.append(second)
    t.delete("o_custkey % 10 = 3", dml.MERGE_ON_READ, keys=["o_custkey"])
    t.append(later)  # newer than the delete: it doesn't reach these rows
    return t.scan()


def _with_nulls(df: DataFrame) -> DataFrame:
    return df.withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))


@query("SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false)")
def delete_null_predicate(s, d):
    t = table_of(s, _with_nulls(raw(s, d, "orders")), "orders")
    t.delete("o_orderstatus = 'F'")
    return t.scan()


UPDATED = "SELECT * REPLACE (CASE WHEN o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 100000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice) FROM orders"


@query(UPDATED)
def update_cow(s, d):
    t = _batches(s, d)
    t.update("o_totalprice > 100000", {"o_orderstatus": "'X'", "o_totalprice": "o_totalprice * 2"})
    return t.scan()


@query(UPDATED)
def update_mor(s, d):
    t = _batches(s, d)
    t.update("o_totalprice > 100000", {"o_orderstatus": "'X'", "o_totalprice": "o_totalprice * 2"}, dml.MERGE_ON_READ)
    return t.scan()


MERGED = """
SELECT t.o_orderkey, t.o_custkey, CASE WHEN t.o_orderkey % 4 = 0 AND t.o_orderkey % 8 <> 0 THEN 'M' ELSE t.o_orderstatus END AS o_orderstatus,
       CASE WHEN t.o_orderkey % 4 = 0 AND t.o_orderkey % 8 <> 0 THEN t.o_totalprice + 1 ELSE t.o_totalprice END AS o_totalprice, t.o_orderdate, t.o_orderpriority
FROM orders t WHERE t.o_orderkey % 2 = 0 AND NOT (t.o_orderkey % 8 = 0)
UNION ALL
SELECT o_orderkey, o_custkey, 'N', o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 = 0
"""


def _merge(s, d, strategy):
    o = raw(s, d, "orders")
    even = o.where("o_orderkey % 2 = 0")
    t = table_of(s, even.where("o_custkey % 2 = 0"), "orders", identifiers=["o_orderkey"])
    t.append(even.where("o_custkey % 2 = 1"))
    source = o.where("o_orderkey % 4 = 0 OR (o_orderkey % 2 = 1)")
    b = t.merge(source, "t.o_orderkey = s.o_orderkey", strategy)
    b.when_matched_delete("s.o_orderkey % 8 = 0").when_matched_update({"o_orderstatus": "'M'", "o_totalprice": "t.o_totalprice + 1"})
    b.when_not_matched_insert({"o_orderkey": "s.o_orderkey", "o_custkey": "s.o_custkey", "o_orderstatus": "'N'", "o_totalprice": "s.o_totalprice", "o_orderdate": "s.o_orderdate", "o_orderpriority": "s.o_orderpriority"}, "s.o_orderkey % 5 = 0")
    t.run(b)
    return t.scan()


@query(MERGED)
def merge_full(s, d):
    return _merge(s, d, dml.COPY_ON_WRITE)


@query(MERGED)
def merge_mor(s, d):
    return _merge(s, d, dml.MERGE_ON_READ)


@query("SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus) FROM orders")
def upsert_orders(s, d):
    o = raw(s, d, "orders")
    t = table_of(s, o.where("o_orderkey % 6 <> 3"), "orders", identifiers=["o_orderkey"])
    t.upsert(o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("U")))
    return t.scan()


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 1")
def overwrite_full(s, d):
    a, b = parts(raw(s, d, "orders"), "o_orderkey", 2)
    t = table_of(s, a, "orders")
    t.overwrite(b)
    return t.scan()


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'F' UNION ALL SELECT * FROM orders WHERE o_orderkey % 2 = 1 AND o_orderstatus = 'F'")
def overwrite_filter(s, d):
    a, b = parts(raw(s, d, "orders"), "o_orderkey", 2)
    t = table_of(s, a, "orders")
    t.overwrite(b.where("o_orderstatus = 'F'"), "o_orderstatus = 'F'")
    return t.scan()


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 1")
def truncate_table(s, d):
    a, b = parts(raw(s, d, "orders"), "o_orderkey", 2)
    t = table_of(s, a, "orders")
    t.truncate()
    t.append(b)
    return t.scan()


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 3 = 0")
def write_table_modes(s, d):
    o, where = raw(s, d, "orders"), working_folder(s, "orders")
    write_table(o.where("o_orderkey % 2 = 1"), where)
    write_table(o.where("o_orderkey % 2 = 0"), where, mode="overwrite")
    write_table(o.where("o_orderkey % 3 = 0"), where, mode="append")
    return read_table(s, where)


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN least(o_totalprice, 200000) ELSE o_totalprice END AS o_totalprice FROM orders")
def update_with_functions(s, d):
    t = table_of(s, raw(s, d, "orders").select("o_orderkey", "o_totalprice"), "orders")
    t.update(F.col("o_totalprice") > 100000, {"o_totalprice": F.least("o_totalprice", F.lit(200000.0))})
    return t.scan()


@query("SELECT CAST(2 AS BIGINT) AS rows_deleted, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey NOT IN (1, 2)")
def delete_counts(s, d):
    t = table_of(s, raw(s, d, "orders"), "orders")
    n = t.delete("o_orderkey IN (1, 2)")
    t.delete("o_orderkey < 0")  # no row, no commit
    if t.snapshot_count() != 2:
        raise AssertionError("a statement that changes nothing was committed")
    return t.scan().agg(F.lit(n).cast("long").alias("rows_deleted"), F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM events WHERE event_id % 2 = 0 AND event_type <> 'click' UNION ALL SELECT * FROM events WHERE event_id % 2 = 1 AND event_type = 'click'")
def overwrite_dynamic(s, d):
    a, b = parts(raw(s, d, "events"), "event_id", 2)
    t = table_of(s, a, "events", ["event_type"])
    t.overwrite(b.where("event_type = 'click'"), dynamic=True)
    return t.scan()


# --- evolution -------------------------------------------------------------------
@query("SELECT *, CASE WHEN c_custkey % 2 = 1 THEN c_acctbal / 2 END AS bonus FROM customer")
def evolve_add(s, d):
    a, b = parts(raw(s, d, "customer"), "c_custkey", 2)
    t = table_of(s, a, "customer")
    t.add_column("bonus", simple("double"))
    t.append(b.withColumn("bonus", F.col("c_acctbal") / 2))
    return t.scan()


@query("SELECT c_custkey, c_name AS full_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def evolve_rename(s, d):
    a, b = parts(raw(s, d, "customer"), "c_custkey", 2)
    t = table_of(s, a, "customer")
    t.rename_column("c_name", "full_name")
    t.append(b.withColumnRenamed("c_name", "full_name"))
    return t.scan()


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, CASE WHEN c_custkey % 2 = 1 THEN c_name END AS c_name FROM customer")
def evolve_drop_readd(s, d):
    a, b = parts(raw(s, d, "customer"), "c_custkey", 2)
    t = table_of(s, a, "customer")
    t.drop_column("c_name")
    t.add_column("c_name", simple("string"))  # another column: old files have none of it
    t.append(b)
    return t.scan()


@query("SELECT c_custkey, c_name, CAST(CASE WHEN c_custkey % 2 = 1 THEN c_nationkey + 5000000000 ELSE c_nationkey END AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def evolve_widen(s, d):
    a, b = parts(raw(s, d, "customer"), "c_custkey", 2)
    t = table_of(s, a, "customer")
    t.widen_column("c_nationkey", simple("long"))
    t.append(b.withColumn("c_nationkey", F.col("c_nationkey") + F.lit(5_000_000_000)))
    return t.scan()


@query("SELECT c_custkey, c_name AS label, CASE WHEN c_custkey % 2 = 1 THEN c_acctbal END AS balance FROM customer")
def evolve_nested(s, d):
    a, b = parts(raw(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", 2)
    t = table_of(s, a.select("c_custkey", F.struct("c_name").alias("info")), "customer")
    t.rename_column("info.c_name", "label")
    t.add_column("balance", simple("double"), parent="info")
    t.append(b.select("c_custkey", F.struct(F.col("c_name").alias("label"), F.col("c_acctbal").alias("balance")).alias("info")))
    return t.scan(["c_custkey", "info.label", "info.balance"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS c_name FROM customer")
def evolve_optional(s, d):
    c = raw(s, d, "customer").select("c_custkey", "c_name")
    a, b = parts(c, "c_custkey", 2)
    t = create_table(s, working_folder(s, "customer"), Schema.of(c.schema, required=("c_custkey", "c_name")))
    t.append(a)
    t.make_optional("c_name")
    t.append(b.withColumn("c_name", F.lit(None).cast("string")))
    return t.scan()


# --- SQL statements over a catalog -------------------------------------------------
def _session(s: SparkSession, d: str, name: str) -> SqlSession:
    catalog = FileCatalog(s, working_folder(s, "catalog"))
    catalog.create_namespace("db")
    catalog.create_table(f"db.{name}", Schema.of(raw(s, d, name).schema)).append(raw(s, d, name))
    return SqlSession(catalog)


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 0")
def sql_as_of(s, d):
    x = _session(s, d, "orders")
    x.sql("DELETE FROM db.orders WHERE o_orderkey % 2 = 1")
    x.sql("DELETE FROM db.orders WHERE o_orderkey % 4 = 0")
    ids = x.catalog.load_table("db.orders").snapshot_ids()
    return x.sql(f"SELECT * FROM db.orders VERSION AS OF {ids[1]}")


@query("SELECT c_custkey, c_name AS label, c_nationkey, c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN 'even' END AS note FROM customer")
def sql_alter(s, d):
    x = _session(s, d, "customer")
    x.sql("ALTER TABLE db.customer ADD COLUMN note STRING")
    x.sql("ALTER TABLE db.customer RENAME COLUMN c_name TO label")
    x.sql("ALTER TABLE db.customer DROP COLUMN c_mktsegment")
    x.sql("UPDATE db.customer SET note = 'even' WHERE c_custkey % 2 = 0")
    return x.sql("SELECT * FROM db.customer")


@query("SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 <> 0")
def sql_merge(s, d):
    x = _session(s, d, "orders")
    raw(s, d, "orders").where("o_orderkey % 3 = 0").createOrReplaceTempView("lakeloom_changed")
    x.sql("MERGE INTO db.orders AS o USING (SELECT * FROM lakeloom_changed) AS n ON o.o_orderkey = n.o_orderkey WHEN MATCHED AND n.o_orderkey % 5 = 0 THEN DELETE WHEN MATCHED THEN UPDATE SET o_totalprice = 0.0")
    return x.sql("SELECT * FROM db.orders")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def sql_optimize(s, d):
    x = _session(s, d, "events")
    for _ in range(5):
        x.sql("INSERT INTO db.events SELECT * FROM db.events WHERE event_id < 0 OR event_id = 1")
    x.sql("DELETE FROM db.events WHERE event_id = 1")
    raw(s, d, "events").where("event_id = 1").createOrReplaceTempView("lakeloom_one")
    x.sql("INSERT INTO db.events SELECT * FROM lakeloom_one")
    x.sql("OPTIMIZE db.events ZORDER BY (user_id, ts)")
    x.sql("VACUUM db.events RETAIN 0 HOURS")
    return x.sql("SELECT event_type, count(*) AS n FROM db.events GROUP BY event_type")


@query("SELECT 'db.customer' AS name, CAST(count(*) AS BIGINT) AS n FROM customer UNION ALL SELECT 'db.nation', count(*) FROM nation")
def catalog_tables(s, d):
    catalog = FileCatalog(s, working_folder(s, "catalog"))
    catalog.create_namespace("db")
    for name in ("customer", "nation", "region"):
        catalog.create_table(f"db.{name}", Schema.of(raw(s, d, name).schema)).append(raw(s, d, name))
    catalog.drop_table("db.region")
    rows = [(str(i), catalog.load_table(i).snapshot.count("total-records")) for i in catalog.list_tables("db")]
    return s.createDataFrame(rows, "name string, n long")


# --- maintenance -----------------------------------------------------------------
def _compacted(s, d, **options) -> Table:
    t = table_of(s, raw(s, d, "events"), "events", append=False)
    for p in parts(raw(s, d, "events"), "event_id", 6):
        t.append(p)
    t.delete("event_type = 'error'", dml.MERGE_ON_READ)
    if t.compact(**options).files_after >= 6:
        raise AssertionError("nothing was compacted")
    return t


EVENTS_LEFT = "SELECT * FROM events WHERE event_type <> 'error'"


@query(EVENTS_LEFT)
def compact_binpack(s, d):
    return _compacted(s, d).scan()


@query(EVENTS_LEFT)
def compact_sort(s, d):
    return _compacted(s, d, strategy="sort", columns=["user_id"]).scan()


@query(EVENTS_LEFT)
def compact_zorder(s, d):
    return _compacted(s, d, strategy="zorder", columns=["user_id", "ts"]).scan()


@query("SELECT CAST(3 AS BIGINT) AS snapshot_id, count(*) AS total_records FROM orders")
def expire_snapshots(s, d):
    t = _batches(s, d)
    t.expire_snapshots(older_than_ms=-1)
    return t.snapshots().select("snapshot_id", F.col("summary")["total-records"].cast("long").alias("total_records"))


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 1")
def remove_orphans(s, d):
    a, b = parts(raw(s, d, "orders"), "o_orderkey", 2)
    t = table_of(s, a, "orders")
    t.overwrite(b)
    if t.vacuum(retain_hours=-1)["removed_files"] < 1:
        raise AssertionError("the overwritten file is still there")
    return open_table(s, t.location).scan()


@query(
    """
SELECT 1 AS field_id, 'c_custkey' AS name, count(c_custkey) AS value_count, count(*) - count(c_custkey) AS null_count, CAST(0 AS BIGINT) AS nan_count, CAST(min(c_custkey) AS VARCHAR) AS lower, CAST(max(c_custkey) AS VARCHAR) AS upper FROM customer
UNION ALL SELECT 2, 'c_name', count(c_name), count(*) - count(c_name), 0, min(c_name), max(c_name) FROM customer
UNION ALL SELECT 3, 'c_nationkey', count(c_nationkey), count(*) - count(c_nationkey), 0, CAST(min(c_nationkey) AS VARCHAR), CAST(max(c_nationkey) AS VARCHAR) FROM customer
UNION ALL SELECT 4, 'c_mktsegment', count(x), count(*) - count(x), 0, min(x), max(x) FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS x FROM customer)
"""
)
def column_stats(s, d):
    c = raw(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("c_mktsegment"))
    return table_of(s, c, "customer").column_stats()


@query("SELECT c_custkey, c_name || '日本語テキスト' AS name, c_acctbal FROM customer")
def compact_zorder_text(s, d):
    c = raw(s, d, "customer").select("c_custkey", F.concat("c_name", F.lit("日本語テキスト")).alias("name"), "c_acctbal")
    t = table_of(s, c, "customer", append=False)
    for p in parts(c, "c_custkey", 6):
        t.append(p)
    t.compact(strategy="zorder", columns=["name", "c_acctbal"], target_size=1 << 10)
    bounds = [e.file for e in t.snapshot.data_files()]
    if len(bounds) < 2 or not len(t.plan("name < 'Customer#00000002'")) < len(bounds):
        raise AssertionError("the files are not laid out by name")
    return t.scan()


@query("SELECT * FROM events WHERE event_type <> 'error'")
def compact_sort_partitioned(s, d):
    e = raw(s, d, "events").where("event_type <> 'error'")
    t = table_of(s, e, "events", ["event_type"], append=False)
    for p in parts(e, "event_id", 6):
        t.append(p)
    t.compact(strategy="sort", columns=["user_id", "ts"])
    place = Window.partitionBy("file").orderBy("pos")
    rows = t.scan().select("user_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("pos"))
    if rows.withColumn("before", F.lag("user_id").over(place)).where("before > user_id").count():
        raise AssertionError("a file is not sorted")
    return t.scan()


@query("SELECT * FROM events")
def compact_filter(s, d):
    """Only the partitions that a condition selects are rewritten."""
    t = table_of(s, raw(s, d, "events"), "events", ["event_type"], append=False)
    for p in parts(raw(s, d, "events"), "event_id", 6):
        t.append(p)
    files = len(t.plan())
    done = t.compact(condition="event_type = 'click'")
    if not 0 < done.files_before < files or not maintenance.needs_compaction(t):
        raise AssertionError("the condition did not select files")
    return t.scan()


# --- changes ---------------------------------------------------------------------
@query("SELECT 'insert' AS change, CAST(sum(CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS records FROM orders")
def cdc_files(s, d):
    t = _batches(s, d)
    return t.file_changes(t.snapshot_ids()[1]).groupBy("change").agg(F.sum("record_count").alias("records"))


CHANGES = """
SELECT 'delete' AS change, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 10 = 0
UNION ALL SELECT 'update', o_orderkey, o_totalprice + 5 FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 10 = 4
UNION ALL SELECT 'insert', o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 1
"""


def _changed(s, d) -> Table:
    a, b = parts(raw(s, d, "orders"), "o_orderkey", 2)
    t = table_of(s, a, "orders", identifiers=["o_orderkey"])
    t.save_checkpoint("reader")
    t.delete("o_orderkey % 10 = 0", dml.MERGE_ON_READ)
    t.update("o_orderkey % 10 = 4", {"o_totalprice": "o_totalprice + 5"})
    t.append(b)
    return t


@query(CHANGES)
def cdc_rows(s, d):
    t = _changed(s, d)
    return t.changes(t.snapshot_ids()[0]).select("change", "o_orderkey", "o_totalprice")


@query(CHANGES)
def cdc_checkpoint(s, d):
    t = open_table(s, _changed(s, d).location)
    return t.changes_since_checkpoint("reader").select("change", "o_orderkey", "o_totalprice")


@query("SELECT * FROM orders WHERE o_orderkey % 10 <> 0")
def stream_cdc(s, d):
    """A copy that is kept up to date from the change stream, batch by batch."""
    t = table_of(s, raw(s, d, "orders").where("o_orderkey % 2 = 0"), "orders", identifiers=["o_orderkey"])
    copy = table_of(s, raw(s, d, "orders"), "copy", append=False, identifiers=["o_orderkey"])
    checkpoint = working_folder(s, "stream")

    def follow(changes: DataFrame, batch_id: int) -> None:
        b = copy.refresh().merge(changes)
        b.when_matched_delete("s.change = 'delete'").when_matched_update().when_not_matched_insert(condition="s.change <> 'delete'")
        copy.run(b)

    stream_changes(s, t.location, follow, checkpoint).awaitTermination()
    t.append(raw(s, d, "orders").where("o_orderkey % 2 = 1"))
    t.delete("o_orderkey % 10 = 0")
    stream_changes(s, t.location, follow, checkpoint).awaitTermination()
    return copy.refresh().scan()


@query("SELECT * FROM orders WHERE o_orderkey % 3 <> 1")
def stream_rollback(s, d):
    """A copy follows over a rollback, with and without a new commit after it."""
    first, middle, last = parts(raw(s, d, "orders"), "o_orderkey", 3)
    t = table_of(s, first, "orders", identifiers=["o_orderkey"])
    copy = table_of(s, raw(s, d, "orders"), "copy", append=False, identifiers=["o_orderkey"])
    checkpoint = working_folder(s, "stream")

    def follow(changes: DataFrame, batch_id: int) -> None:
        b = copy.refresh().merge(changes)
        b.when_matched_delete("s.change = 'delete'").when_matched_update().when_not_matched_insert(condition="s.change <> 'delete'")
        copy.run(b)

    def catch_up() -> None:
        stream_changes(s, t.location, follow, checkpoint).awaitTermination()

    t.append(middle)
    catch_up()
    t.rollback_to(t.snapshot_ids()[0])
    catch_up()
    if copy.refresh().scan().count() != first.count():
        raise AssertionError("the rollback did not reach the copy")
    t.append(middle.limit(10))
    t.rollback_to(t.snapshot_ids()[0])
    t.append(last)
    catch_up()
    return copy.refresh().scan()


@query("SELECT * FROM events")
def stream_sink_replay(s, d):
    """A batch that comes again after its snapshot has expired is not appended again."""
    e = raw(s, d, "events")
    t = table_of(s, e, "events", append=False)
    sink = append_batch(t.location, "events-copy")
    for k, batch in enumerate(parts(e, "event_id", 2)):
        sink(batch, k)
    t.refresh().expire_snapshots(older_than_ms=-1)
    for k, batch in enumerate(parts(e, "event_id", 2)):
        sink(batch, k)
    return t.refresh().scan()


@query("SELECT * FROM events")
def stream_sink(s, d):
    e = raw(s, d, "events")
    t = table_of(s, e, "events", append=False)
    stream = s.readStream.schema(e.schema).parquet(f"{d}/events.parquet*")
    write_stream(stream, t.location, "events-copy", working_folder(s, "stream")).awaitTermination()
    return t.refresh().scan()


@query("SELECT 'first' AS winner, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 AND o_totalprice <= 100000")
def multi_writer_conflict(s, d):
    t = table_of(s, raw(s, d, "orders").where("o_orderkey % 2 = 0"), "orders")
    late = open_table(s, t.location)
    second = dml.delete(late, "o_totalprice > 50000")
    t.delete("o_totalprice > 100000")
    winner = "second"
    try:
        second.commit()
    except CommitConflict:
        winner = "first"
    return t.refresh().scan().agg(F.count(F.lit(1)).alias("n")).select(F.lit(winner).alias("winner"), "n")


@query("SELECT * FROM orders")
def concurrent_appends(s, d):
    a, b = parts(raw(s, d, "orders"), "o_orderkey", 2)
    t = table_of(s, a, "orders", append=False)
    late = open_table(s, t.location)
    t.append(a)
    late.append(b)  # an append moves on to the newer state
    return t.refresh().scan()


# --- the inherited query layer, over engine tables ----------------------------------
def inherited(name: str, sql: str, tables: list[str], spark_sql: str | None = None) -> None:
    """Registers SQL that runs over engine tables in Spark and over the raw files in DuckDB."""

    def build(s: SparkSession, d: str) -> DataFrame:
        text = spark_sql or sql
        for t in tables:
            table_of(s, raw(s, d, t), t).create_view(f"lakeloom_{t}")
            text = text.replace(f"@{t}", f"lakeloom_{t}")
        return s.sql(text)

    oracle = sql
    for t in tables:
        oracle = oracle.replace(f"@{t}", t)
    build.__name__ = name
    QUERIES[name], ORACLES[name] = build, oracle


inherited("join_inner", "SELECT o_orderkey, c_name, n_name FROM @orders JOIN @customer ON o_custkey = c_custkey JOIN @nation ON c_nationkey = n_nationkey", ["orders", "customer", "nation"])
inherited(
    "join_kinds",
    """
SELECT 'left' AS kind, CAST(count(*) AS BIGINT) AS n, CAST(count(o_orderkey) AS BIGINT) AS m FROM @customer LEFT JOIN @orders ON c_custkey = o_custkey AND o_totalprice > 200000
UNION ALL SELECT 'right', count(*), count(c_custkey) FROM (SELECT * FROM @customer WHERE c_acctbal > 0) c RIGHT JOIN @orders ON c_custkey = o_custkey
UNION ALL SELECT 'full', count(*), count(c_custkey) FROM (SELECT * FROM @customer WHERE c_custkey % 2 = 0) c FULL JOIN (SELECT * FROM @orders WHERE o_custkey % 3 = 0) o ON c_custkey = o_custkey
UNION ALL SELECT 'semi', count(*), count(c_custkey) FROM @customer WHERE EXISTS (SELECT 1 FROM @orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)
UNION ALL SELECT 'anti', count(*), count(c_custkey) FROM @customer WHERE NOT EXISTS (SELECT 1 FROM @orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'cross', count(*), count(n_nationkey) FROM @nation CROSS JOIN @region
UNION ALL SELECT 'theta', count(*), count(b.n_nationkey) FROM @nation a JOIN @nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey
""",
    ["customer", "orders", "nation", "region"],
)
inherited("subqueries", "SELECT o_orderkey, o_totalprice FROM @orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM @orders i WHERE i.o_custkey = o.o_custkey)", ["orders"])
inherited(
    "aggregates",
    """
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS qty, min(l_extendedprice) AS low, max(l_extendedprice) AS high, CAST(count(*) AS BIGINT) AS n,
       CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, CAST(count(*) FILTER (WHERE l_discount > 0.05) AS BIGINT) AS discounted, round(avg(l_tax), 6) AS tax, round(stddev_samp(l_quantity), 6) AS spread
FROM @lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10
""",
    ["lineitem"],
)
inherited(
    "rollup_cube",
    """
SELECT 'rollup' AS kind, o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM @orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
UNION ALL SELECT 'cube', o_orderstatus, o_orderpriority, count(*) FROM @orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
UNION ALL SELECT 'sets', o_orderstatus, o_orderpriority, count(*) FROM @orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
""",
    ["orders"],
)
inherited(
    "window_rank",
    """
SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER w AS INT) AS rk, CAST(dense_rank() OVER w AS INT) AS dr, CAST(ntile(4) OVER w AS INT) AS nt,
       lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after, first_value(o_orderkey) OVER w AS first_key,
       CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS near
FROM @orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)
""",
    ["orders"],
)
inherited("top_k", "SELECT o_orderkey, o_totalprice FROM @orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", ["orders"])
inherited(
    "set_ops",
    """
(SELECT 'except_all' AS kind, o_custkey AS k FROM (SELECT o_custkey FROM @orders EXCEPT ALL SELECT c_custkey FROM @customer))
UNION ALL (SELECT 'intersect', k FROM (SELECT o_custkey AS k FROM @orders INTERSECT SELECT c_custkey FROM @customer WHERE c_acctbal > 0))
UNION ALL (SELECT 'union', k FROM (SELECT c_nationkey AS k FROM @customer UNION SELECT s_nationkey FROM @supplier))
""",
    ["orders", "customer", "supplier"],
)
inherited(
    "scalar_functions",
    """
SELECT c_custkey, upper(c_name) AS up, substring(c_name, 1, 4) AS sub, length(c_name) AS len, concat(c_mktsegment, '-', c_name) AS cat, trim('  x ') AS tr, lpad(CAST(c_nationkey AS VARCHAR(10)), 4, '0') AS pad,
       replace(c_name, 'Customer', 'C') AS rep, round(c_acctbal, 1) AS rnd, abs(c_acctbal) AS ab, floor(c_acctbal) AS fl, greatest(c_nationkey, 5) AS gr, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS co,
       CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'ok' END AS state
FROM @customer
""",
    ["customer"],
    None,
)
ORACLES["scalar_functions"] = ORACLES["scalar_functions"].replace("floor(c_acctbal)", "CAST(floor(c_acctbal) AS BIGINT)").replace("length(c_name)", "CAST(length(c_name) AS INT)")
inherited("date_functions", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, date_trunc('month', o_orderdate) AS first_day, CAST(datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days FROM @orders", ["orders"], "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS first_day, datediff(CAST(o_orderdate AS DATE), DATE '1990-01-01') AS days FROM @orders")
inherited("json_functions", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM @events", ["events"], "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM @events")
inherited("cte_pivot", "WITH x AS (SELECT o_custkey, o_orderstatus FROM @orders) SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS o FROM x GROUP BY o_custkey", ["orders"], "SELECT o_custkey, coalesce(F, 0) AS f, coalesce(O, 0) AS o FROM (SELECT o_custkey, o_orderstatus, 1 AS one FROM @orders) PIVOT (count(one) FOR o_orderstatus IN ('F' AS F, 'O' AS O))")


inherited(
    "window_frames",
    """
SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_totalprice AS INT) RANGE BETWEEN 5000 PRECEDING AND 5000 FOLLOWING) AS BIGINT) AS around,
       last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key,
       nth_value(o_orderkey, 2) OVER w AS second_key, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd
FROM @orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)
""",
    ["orders"],
    # DuckDB rounds a double to the nearest integer, halves to the even one, and puts nulls last.
    """
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(rint(o_totalprice) AS INT) NULLS LAST RANGE BETWEEN 5000 PRECEDING AND 5000 FOLLOWING) AS around,
       last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice NULLS LAST, o_orderkey NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key,
       nth_value(o_orderkey, 2) OVER w AS second_key, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd
FROM @orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice NULLS LAST, o_orderkey NULLS LAST)
""",
)
inherited("statistics", "SELECT o_orderstatus, round(corr(o_custkey, o_totalprice), 6) AS c, round(covar_samp(o_custkey, o_totalprice), 2) AS cov, round(var_pop(o_totalprice), 0) AS v, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 6) AS med, max_by(o_orderkey, o_totalprice) AS top, min_by(o_orderkey, o_totalprice) AS low, bool_and(o_totalprice > 0) AS pos FROM @orders GROUP BY o_orderstatus", ["orders"])
inherited(
    "approximate",
    "SELECT CAST(count(DISTINCT n_regionkey) AS BIGINT) AS regions, CAST(count(DISTINCT n_nationkey) AS BIGINT) AS nations FROM @nation",
    ["nation"],
    "SELECT approx_count_distinct(n_regionkey, 0.01) AS regions, approx_count_distinct(n_nationkey, 0.01) AS nations FROM @nation",
)
inherited("approximate_percentile", "SELECT o_orderstatus, quantile_disc(o_totalprice, 0.5) AS med FROM @orders GROUP BY o_orderstatus", ["orders"], "SELECT o_orderstatus, percentile_approx(o_totalprice, 0.5, 1000000) AS med FROM @orders GROUP BY o_orderstatus")
inherited("collections", "SELECT c_nationkey, array_to_string(list_sort(list(c_custkey)), ',') AS ids, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM @customer GROUP BY c_nationkey", ["customer"], "SELECT c_nationkey, array_join(array_sort(collect_list(c_custkey)), ',') AS ids, array_join(array_sort(collect_set(c_mktsegment)), ',') AS segments FROM @customer GROUP BY c_nationkey")
inherited("lateral_join", "SELECT c_custkey, o_orderkey, o_totalprice FROM @customer, LATERAL (SELECT o_orderkey, o_totalprice FROM @orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS x", ["customer", "orders"])
inherited("regex_functions", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS digits, regexp_replace(c_name, '[0-9]+', '#') AS masked, regexp_matches(c_name, '7$') AS seven, string_split(c_name, '#')[1] AS head FROM @customer", ["customer"], "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS digits, regexp_replace(c_name, '[0-9]+', '#') AS masked, c_name RLIKE '7$' AS seven, split(c_name, '#')[0] AS head FROM @customer")
inherited("higher_order", "SELECT vec_id, CAST(round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS DOUBLE) AS norm, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS positive FROM @embeddings", ["embeddings"], "SELECT vec_id, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), CAST(0 AS DOUBLE), (a, x) -> a + x), 4) AS norm, size(filter(embedding, x -> x > 0)) AS positive FROM @embeddings")
inherited("explode_rows", "SELECT vec_id, CAST(p AS INT) AS pos, CAST(embedding[p + 1] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS p FROM @embeddings)", ["embeddings"], "SELECT vec_id, pos, CAST(x AS DOUBLE) AS x FROM @embeddings LATERAL VIEW posexplode(embedding) e AS pos, x")
inherited("json_struct", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM @events", ["events"], "SELECT event_id, from_json(props, 'k BIGINT').k AS k FROM @events")
inherited("time_functions", "SELECT event_id, CAST(strftime(ts, '%Y-%m-%d %H') AS VARCHAR) AS h, CAST(ts AS DATE) + INTERVAL 3 DAY AS later, CAST(hour(ts) AS INT) AS hh, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket FROM @events", ["events"], "SELECT event_id, date_format(ts, 'yyyy-MM-dd HH') AS h, CAST(date_add(CAST(ts AS DATE), 3) AS TIMESTAMP_NTZ) AS later, hour(ts) AS hh, CAST(window(ts, '6 hours').start AS TIMESTAMP_NTZ) AS bucket FROM @events")
inherited("math_functions", "SELECT o_orderkey, round(pow(o_totalprice, 0.5), 6) AS r, round(sqrt(o_totalprice), 6) AS q, round(ln(o_totalprice), 6) AS l, CAST(((o_orderkey % 7) + 7) % 7 AS INT) AS m, CAST(sign(o_totalprice - 100000) AS DOUBLE) AS s, CAST(ceil(o_totalprice) AS BIGINT) AS c FROM @orders", ["orders"], "SELECT o_orderkey, round(pow(o_totalprice, 0.5), 6) AS r, round(sqrt(o_totalprice), 6) AS q, round(ln(o_totalprice), 6) AS l, CAST(pmod(o_orderkey, 7) AS INT) AS m, sign(o_totalprice - 100000) AS s, ceil(o_totalprice) AS c FROM @orders")
inherited(
    "set_ops_all",
    """
(SELECT 'intersect_all' AS kind, k FROM (SELECT o_custkey AS k FROM @orders INTERSECT ALL SELECT o_custkey FROM @orders WHERE o_totalprice > 100000))
UNION ALL (SELECT 'except', k FROM (SELECT c_custkey AS k FROM @customer EXCEPT SELECT o_custkey FROM @orders))
""",
    ["orders", "customer"],
)
inherited("values_rows", "SELECT n_name, label FROM @nation JOIN (VALUES (0, 'a'), (1, 'b'), (2, 'c')) AS v(k, label) ON n_regionkey = k", ["nation"])


@query("SELECT vec_id, len(embedding) AS n, embedding[1] AS first, label FROM embeddings")
def nested_types(s, d):
    e = raw(s, d, "embeddings")
    t = table_of(s, e.select("vec_id", F.struct("embedding", F.create_map(F.lit("label"), "label").alias("tags")).alias("v")), "embeddings")
    return t.scan().select("vec_id", F.size("v.embedding").cast("long").alias("n"), F.col("v.embedding")[0].alias("first"), F.col("v.tags")["label"].alias("label"))


@query("SELECT o_orderkey, o_totalprice, NULL AS note FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, 'new' FROM orders WHERE o_orderkey % 2 = 1")
def union_diagonal(s, d):
    a, b = parts(raw(s, d, "orders"), "o_orderkey", 2)
    one = table_of(s, a.select("o_orderkey", "o_totalprice"), "left").scan()
    two = table_of(s, b.select("o_orderkey", F.lit("new").alias("note")), "right").scan()
    return one.unionByName(two, allowMissingColumns=True)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_per_key(s, d):
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    o = table_of(s, raw(s, d, "orders"), "orders").scan()
    return o.withColumn("rn", F.row_number().over(newest)).where("rn = 1").select("o_custkey", "o_orderkey", "o_totalprice")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by brand over a table written in two appends."""
    return append_two_snapshots_revenue_by_brand(spark, sf_dir)
