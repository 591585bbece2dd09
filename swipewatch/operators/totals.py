"""Grouped totals, class counts, named-feature averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cents, number


def _money(df, amount):
    return F.count("*").alias("txns"), (F.sum(cents(number(df, amount))) / 100.0).alias("amount")


def user_totals(df: DataFrame, user="user_id", amount="amount") -> DataFrame:
    return df.groupBy(user).agg(*_money(df, amount))


def period_totals(df: DataFrame, time="transaction_date", amount="amount", period="day") -> DataFrame:
    start = F.date_trunc(period, F.col(time)).cast("timestamp_ntz").alias("period")
    return df.groupBy(start).agg(*_money(df, amount))


def user_day_rollup(df: DataFrame, user="user_id", time="transaction_date", amount="amount") -> DataFrame:
    """Totals per user and day, per user, and overall, with the grouping level."""
    day = F.to_date(time).alias("day")
    return (
        df.select(F.col(user), day, F.col(amount))
        .rollup(user, "day")
        .agg(*_money(df, amount), F.grouping_id().cast("int").alias("level"))
    )


def class_weights(df: DataFrame, label="fraud") -> DataFrame:
    """Class counts, number of classes, and negatives per positive (1.0 if either is missing)."""
    per_class = df.groupBy(label).agg(F.count("*").alias("n"))
    out = per_class.agg(
        F.coalesce(F.sum(F.when(F.col(label) == 1, F.col("n"))), F.lit(0)).alias("positives"),
        F.coalesce(F.sum(F.when(F.col(label) == 0, F.col("n"))), F.lit(0)).alias("negatives"),
        F.count(label).alias("classes"),
    )
    return out.selectExpr(
        "positives",
        "negatives",
        "classes",
        "IF(positives = 0 OR negatives = 0, 1D, negatives / positives) AS scale_pos_weight",
    )


def average_features(df: DataFrame, features: str, by: str | None = None) -> DataFrame:
    """Mean of each named feature over *all* records; an absent name counts as zero.

    ``features`` is a ``map<string,double>`` column; the result has one map, or one per key.
    """
    keys = [by] if by else []
    # a group's number of records travels as one more name, which no feature has: null
    named = df.select(*keys, F.explode(features).alias("name", "x"))
    counted = df.select(*keys, F.lit(None).cast("string").alias("name"), F.lit(1.0).alias("x"))
    sums = named.unionByName(counted).groupBy(*keys, "name").agg(F.sum("x").alias("x"))
    # one map per key is the result's form, so its names meet in one row
    grouped = sums.groupBy(*keys).agg(
        F.max(F.when(F.col("name").isNull(), F.col("x"))).alias("records"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "x"))))
        ).alias("m"),
    )
    return grouped.select(*keys, F.transform_values("m", lambda k, v: v / F.col("records")).alias("averages"))
