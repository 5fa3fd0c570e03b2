"""Analytic tables seen as transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.operators.skew import left_join_skewed

# Customers with more orders are joined apart.
MAX_KEY_ROWS = 1_000_000


def events_as_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """``events``: the value is the amount and the event type the merchant."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("user_id").cast("long").alias("user_id"),
        F.col("value").cast("double").alias("amount"),
        F.lit("USD").alias("currency"),
        F.col("event_type").alias("merchant"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit(None).cast("string").alias("location"),
    )


def orders_as_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` with the customer's nation as the location and the priority as the merchant."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    customer = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", "c_nationkey")
    nation = spark.read.parquet(f"{folder}/nation.parquet").select("n_nationkey", "n_name")
    # Nations are joined to the smaller side first.
    located = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")
    # The orders of a large customer stay where they are.
    located = located.withColumnRenamed("c_custkey", "o_custkey")
    return left_join_skewed(orders, located, ["o_custkey"], MAX_KEY_ROWS).select(
        F.col("o_orderkey").cast("string").alias("transaction_id"),
        F.col("o_custkey").cast("long").alias("user_id"),
        F.col("o_totalprice").cast("double").alias("amount"),
        F.lit("USD").alias("currency"),
        F.col("o_orderpriority").alias("merchant"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("n_name").alias("location"),
    )
