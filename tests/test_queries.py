"""Every registered table query against its SQL over the raw files."""

import pytest

from lakeloom import queries

from .conftest import SMALL, rows_of


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, same_as_sql, name):
    same_as_sql(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name])


def test_hour_partitions_hold_the_whole_table(spark, monkeypatch):
    tables, pruned = [], queries._pruned
    monkeypatch.setattr(queries, "_pruned", lambda t, condition: tables.append(t) or pruned(t, condition))
    queries.partition_hour_events(spark, SMALL)
    assert tables[0].scan().count() == spark.read.parquet(f"{SMALL}/events.parquet").count()


def test_window_frames_round_prices_like_the_sql(spark, duck, tmp_path):
    prices = [10.5, 5010.6, 5011.4, 11.5, 12.5, 10011.49, -0.5, -4999.5, None, None]
    rows = ", ".join(f"({i}, {i % 2 if i > 7 else 0}, {'NULL' if x is None else x})" for i, x in enumerate(prices))
    types = "CAST(k AS BIGINT) AS o_orderkey, CAST(c AS BIGINT) AS o_custkey, CAST(p AS DOUBLE) AS o_totalprice"
    duck.sql(f"COPY (SELECT {types} FROM (VALUES {rows}) AS v(k, c, p)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    sql = queries.ORACLES["window_frames"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet'")
    got = queries.QUERIES["window_frames"](spark, str(tmp_path))
    want = duck.sql(sql)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_all_queries_have_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
