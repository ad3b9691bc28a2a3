"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from ledgerloom.plans import queries as core

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in core.NAMES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(got, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in got), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_matches_sql(spark, duck, name):
    df = core.QUERIES[name](spark, FOLDER)
    want = duck.sql(core.SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    assert rows(df.select(*columns).collect(), range(len(columns))) == rows(want.fetchall(), [list(want.columns).index(c) for c in columns])


def test_seeds_of_examples_round_as_in_sql(spark, duck, tmp_path):
    spark.createDataFrame([(k, k, v) for k, v in enumerate([1.15, 1.16, 4.35, 2.675, 0.285, 1.005])], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want = duck.sql(core.EXAMPLES.replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'") + " ORDER BY 1").fetchall()
    assert [tuple(r) for r in core._examples(spark, str(tmp_path)).orderBy("example_id").collect()] == [tuple(map(float, r)) for r in want]


def test_a_scan_whose_first_task_has_no_rows_leaves_no_empty_pack(spark, duck, tmp_path):
    spark.read.parquet(f"{FOLDER}/orders.parquet").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = core.QUERIES["strict_predictions"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == duck.sql(f"SELECT count(*) FROM ({core.SQL['strict_predictions']})").fetchall()[0][0]
    assert "empty file" not in {r.error for r in got}
