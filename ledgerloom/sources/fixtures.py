"""Invoices and payments derived from the orders table; o_orderkey % 10 picks the case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

INVOICES = """
SELECT concat('I', lpad(cast(o_orderkey AS varchar(20)), 9, '0')) AS record_id, 'invoice' AS record_type,
 CASE WHEN o_orderkey % 10 = 1 THEN concat('X-', cast(o_orderkey AS varchar(20))) END AS external_id,
 CAST(o_totalprice AS DECIMAL(20,4)) AS amount,
 CASE o_custkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'AUD' ELSE 'GBP' END AS currency,
 CAST(o_orderdate AS DATE) AS record_date,
 concat('INV-', cast(o_orderkey AS varchar(20))) AS reference,
 concat('cust-', cast(o_custkey AS varchar(20))) AS party,
 CAST(0 AS DECIMAL(20,4)) AS fee_amount
FROM orders"""

PAYMENTS = """
SELECT record_id, record_type, external_id, amount, currency, CAST(record_ts AS DATE) AS record_date, reference, party, fee_amount
FROM (
WITH b AS (
 SELECT o_orderkey AS k, CAST(o_orderkey % 10 AS int) AS s, CAST(o_totalprice AS DECIMAL(20,4)) AS amt,
  CAST(o_totalprice * 0.4 AS DECIMAL(20,2)) AS part,
  CASE o_custkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'AUD' ELSE 'GBP' END AS cur,
  CAST(o_orderdate AS DATE) AS d, concat('cust-', cast(o_custkey AS varchar(20))) AS party FROM orders),
c AS (SELECT b.*, 0 AS leg FROM b WHERE s <> 6 UNION ALL SELECT b.*, 1 AS leg FROM b WHERE s IN (5, 7))
SELECT concat('P', lpad(cast(k AS varchar(20)), 9, '0'), '-', cast(leg AS varchar(2))) AS record_id, 'payment' AS record_type,
 CASE WHEN s = 1 THEN concat('X-', cast(k AS varchar(20))) END AS external_id,
 CAST(CASE WHEN s = 4 THEN amt - 2.5 WHEN s = 5 AND leg = 0 THEN part WHEN s = 5 THEN amt - part ELSE amt END AS DECIMAL(20,4)) AS amount,
 CASE WHEN s = 8 THEN 'JPY' ELSE cur END AS currency,
 CASE WHEN s = 3 THEN d + INTERVAL 2 DAY WHEN s = 5 THEN d + INTERVAL 1 DAY WHEN s = 9 THEN d + INTERVAL 10 DAY ELSE d END AS record_ts,
 CASE WHEN s IN (0, 8) THEN concat('inv-', cast(k AS varchar(20)), ' ') END AS reference,
 party, CAST(CASE WHEN s = 4 THEN 2.5 ELSE 0 END AS DECIMAL(20,4)) AS fee_amount
FROM c
) z"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived table, by SQL over `orders` given as an argument, so that no view is left in the catalog."""
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=_table(spark, sf_dir, "orders"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, INVOICES)


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, PAYMENTS)
