"""The stored event tables read as transactions, so that every query has data to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def transactions_from_events(events: DataFrame) -> DataFrame:
    """``events`` as a transaction table with every role column."""
    slot = F.col("event_id") % 20
    status = (
        F.when(F.col("event_type") == "error", "declined")
        .when(F.col("event_type") == "signup", "reversed")
        .otherwise("approved")
    )
    risk = (
        F.lit(2)
        + F.when(F.col("value") > 115, 8).otherwise(0)
        + F.when(F.col("event_type") == "error", 5).when(F.col("event_type") == "signup", 8).otherwise(0)
    )
    return events.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("merchant_id"),
        F.col("ts").cast("timestamp").alias("transaction_date"),
        F.col("value").alias("amount"),
        F.when(slot < 12, "USD").when(slot < 17, "EUR").otherwise("GBP").alias("currency"),
        status.alias("status"),
        F.when((F.col("event_id") * 7919) % 100 < risk, 1).otherwise(0).alias("fraud"),
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return transactions_from_events(table(spark, folder, "events"))


def transactions_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The same with every 17th amount missing."""
    txns = transactions(spark, folder)
    return txns.withColumn("amount", F.when(F.col("transaction_id") % 17 != 0, F.col("amount")))


def users(spark: SparkSession, folder: str) -> DataFrame:
    """``customer`` as the users dimension."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("user_name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.lit(None).cast("string").alias("phone"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )
