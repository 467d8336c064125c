"""Readers of the tables, and the views that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CURRENCIES = ("ZAR", "USD", "JPY", "EUR", "AED")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bookings in cents: finished ones are income, others expense; currency by the customer's region."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    by_region = F.array(*map(F.lit, CURRENCIES))
    where = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select(
        "c_custkey", F.element_at(by_region, F.col("n_regionkey") + 1).alias("currency")
    )
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return orders.join(where, orders.o_custkey == where.c_custkey).select(
        F.col("o_orderkey").alias("tx_id"),
        F.col("o_custkey").alias("account_id"),
        F.to_date("o_orderdate").alias("booking_date"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.when(F.col("o_orderstatus") == "F", cents).otherwise(-cents).alias("amount_cents"),
        "currency",
        F.col("o_orderpriority").alias("counterparty"),
    )


LEDGER_SQL = """
ledger AS (
  SELECT o_orderkey AS tx_id, o_custkey AS account_id, o_orderdate::DATE AS booking_date,
         strftime(o_orderdate, '%Y-%m') AS month,
         (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END) * round(o_totalprice * 100)::BIGINT AS amount_cents,
         ['ZAR', 'USD', 'JPY', 'EUR', 'AED'][n_regionkey + 1] AS currency, o_orderpriority AS counterparty
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly statements of each account, with balances carried forward."""
    monthly = ledger(spark, sf_dir).groupBy("account_id", "month").agg(
        F.min("booking_date").alias("period_start"),
        F.max("booking_date").alias("period_end"),
        F.sum(F.greatest("amount_cents", F.lit(0))).alias("credits"),
        F.sum(F.least("amount_cents", F.lit(0))).alias("debits"),
    )
    closing = F.sum(F.col("credits") + F.col("debits")).over(Window.partitionBy("account_id").orderBy("month"))
    return monthly.withColumn("closing", closing).withColumn("opening", F.col("closing") - F.col("credits") - F.col("debits"))


STATEMENTS_SQL = (
    LEDGER_SQL
    + """,
statements AS (
  SELECT *, closing - credits - debits AS opening FROM (
    SELECT *, sum(credits + debits) OVER (PARTITION BY account_id ORDER BY month)::BIGINT AS closing FROM (
      SELECT account_id, month, min(booking_date) AS period_start, max(booking_date) AS period_end,
             sum(greatest(amount_cents, 0))::BIGINT AS credits, sum(least(amount_cents, 0))::BIGINT AS debits
      FROM ledger GROUP BY 1, 2)))"""
)
