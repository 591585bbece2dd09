"""Missing values and outliers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_POLICY, ScalePolicy
from ..functions.scalars import is_missing, number
from ..plans.ranks import quantiles


def remove_missing(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is neither null nor NaN."""
    return df.filter(~is_missing(df, column))


def value_stats(df: DataFrame, column: str, by=()) -> DataFrame:
    """Mean and sample standard deviation; one value alone has no deviation (null)."""
    x = number(df, column)
    aggs = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def remove_outliers(df: DataFrame, column: str, threshold: float = 3.0, by: str | None = None) -> DataFrame:
    """Keep rows within ``threshold`` sample deviations of the mean, overall or per ``by``.

    Missing values take no part in the statistics and stay. Without spread all rows stay.
    Per key, the statistics are one aggregated row each and are joined back, so a busy key is
    never gathered in one window.
    """
    x = number(df, column)
    if by is None:
        s = value_stats(df, column).first()
        if not s["sd"]:
            return df
        return df.filter(x.isNull() | (F.abs(x - F.lit(s["mean"])) <= threshold * s["sd"]))
    stats = value_stats(df, column, [by]).select(
        F.col(by).alias("__by"), F.col("mean").alias("__mean"), F.col("sd").alias("__sd")
    )
    far = (F.col("__sd") > 0) & (F.abs(x - F.col("__mean")) > threshold * F.col("__sd"))
    kept = df.join(stats, F.col(by).eqNullSafe(F.col("__by")), "left").filter(~F.coalesce(far, F.lit(False)))
    return kept.select(*df.columns)


@dataclass(frozen=True)
class AmountRule:
    """What :func:`fit_amount_rule` learned: replace outliers and gaps by ``median``."""

    mean: float | None
    sd: float | None
    median: float
    threshold: float

    def apply(self, df: DataFrame, column: str) -> DataFrame:
        x = number(df, column)
        value = x
        if self.sd:
            far = F.abs((x - F.lit(self.mean)) / F.lit(self.sd)) > self.threshold
            value = F.when(far, F.lit(self.median)).otherwise(x)
        return df.withColumn(column, F.coalesce(value, F.lit(self.median)))


def fit_amount_rule(
    df: DataFrame, column: str, threshold: float = 4.0, policy: ScalePolicy = DEFAULT_POLICY
) -> AmountRule:
    s = value_stats(df, column).first()
    inliers = df.select(number(df, column).alias("x")).filter("x IS NOT NULL")
    if s["sd"]:
        inliers = inliers.filter(F.abs(F.col("x") - F.lit(s["mean"])) <= threshold * s["sd"])
    median = quantiles(inliers, ["x"], [0.5], policy)["x"][0.5]
    return AmountRule(s["mean"], s["sd"], 0.0 if median is None else median, threshold)


def clean_amount(
    df: DataFrame,
    column: str = "amount",
    threshold: float = 4.0,
    fit_on: DataFrame | None = None,
    policy: ScalePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Replace outliers and gaps by the median of the inliers.

    The statistics come from all rows by default; pass the training rows as ``fit_on`` to
    keep test rows out of them.
    """
    return fit_amount_rule(df if fit_on is None else fit_on, column, threshold, policy).apply(df, column)
