"""Queries on all rows, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from chainloom.oracle import ORACLE
from chainloom.plans import series
from chainloom.queries import QUERIES

SF = "/root/testdata/sf0.001"


def same(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "part", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    out = con.execute(ORACLE[name])
    names = [d[0] for d in out.description]
    plain = lambda rows: sorted((tuple(float(x) if hasattr(x, "as_tuple") else x for x in r) for r in rows), key=repr)
    want = plain(out.fetchall())
    assert want and plain(tuple(r) for r in got.select(*names).collect()) == want


@pytest.mark.parametrize("name", ["perimeter_filter", "exposure_status", "flag_stories", "resolution_cases", "witness_reduce"])
def test_all_events_are_reduced(spark, name):
    same(spark, name)


def test_order_is_checked_across_blocks(spark):
    same(spark, "order_violations")
    rows = spark.createDataFrame([(i, v, i // 3) for i, v in enumerate([1, 2, 3, 3, 4, 5, 4, 5, 6])], "line long, v long, part long")
    assert [series.in_order(rows, ["v"], strict, "part").first()[0] for strict in (True, False)] == [2, 1]
    assert series.in_order(rows.limit(0), ["v"], True, "part").first()[0] == 0


@pytest.mark.parametrize("name", ["address_codec", "utxo_census_pivot", "daily_carry_forward", "same_key"])
def test_all_parts_types_and_users_are_read(spark, name):
    same(spark, name)


def test_same_key_pairs_parts_of_any_number(spark, tmp_path):
    rows = [(1, 7), (150, 7), (201, 7), (900, 7), (1001, 8)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {tuple(r) for r in QUERIES["same_key"](spark, str(tmp_path)).select("pos_a", "pos_b").collect()}
    assert got == {(1, 150), (1, 900), (150, 201), (201, 900)}


def test_grids_reach_the_last_height(spark, tmp_path):
    for t in ("lineitem", "part", "customer", "events"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    later = F.expr("o_orderdate + interval 400 days").cast(orders.schema["o_orderdate"].dataType)
    orders.withColumn("o_orderdate", later).write.parquet(str(tmp_path / "orders.parquet"))
    n = orders.count()
    curve = QUERIES["reuse_curve_grid"](spark, str(tmp_path)).collect()
    assert sum(max(r[f"{k}_hits"] for r in curve) for k in "FOP") == n
    assert sum(r.all_hits for r in QUERIES["curve_deltas"](spark, str(tmp_path)).collect()) == n
    assert sum(r.total for r in QUERIES["revelation_windows"](spark, str(tmp_path)).collect()) == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey").distinct().count()


@pytest.mark.parametrize("name", ["curve_deltas", "reuse_curve_grid", "revelation_windows"])
def test_grids_of_the_given_tables_stay(spark, name):
    same(spark, name)
