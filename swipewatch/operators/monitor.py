"""Monitoring: activity per time window, drift between periods, metrics per day."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_POLICY, ScalePolicy
from ..functions.scalars import cents, number
from ..plans.ranks import quantiles
from .metrics import ranking_metrics, threshold_metrics


def window_activity(df: DataFrame, width="1 hour", time="transaction_date", amount="amount", label="fraud") -> DataFrame:
    """Transactions, fraud rate and mean amount per tumbling window; batch or streaming."""
    money = cents(number(df, amount))
    return (
        df.groupBy(F.window(time, width).alias("w"))
        .agg(F.count("*").alias("txns"), F.sum(label).alias("frauds"), F.sum(money).alias("__c"),
             F.count(money).alias("__n"))
        .selectExpr(
            "cast(w.start AS timestamp_ntz) AS window_start",
            "txns",
            "frauds / txns AS fraud_rate",
            "__c / __n / 100D AS mean_amount",
        )
    )


def alerts(activity: DataFrame, max_fraud_rate: float = 0.1, max_txns: int | None = None) -> DataFrame:
    """Windows over a limit."""
    over = F.col("fraud_rate") > max_fraud_rate
    if max_txns is not None:
        over = over | (F.col("txns") > max_txns)
    return activity.filter(over)


def stability_index(
    df: DataFrame, features, period, bins: int = 10, policy: ScalePolicy = DEFAULT_POLICY, floor: float = 1e-4
) -> DataFrame:
    """Population stability index per feature between base rows and current rows.

    ``period`` is a boolean column: true for the current period. Bins are cut at the exact
    quantiles of the base period. All features are counted in one pass; shares below
    ``floor`` count as ``floor``.
    """
    features = list(features)
    values = df.select(period.alias("__now"), *[number(df, f).alias(f) for f in features])
    probs = [j / bins for j in range(1, bins)]
    cuts = quantiles(values.filter("NOT __now").select(*features), features, probs, policy)
    # number of cuts at or below the value; the cuts are constants, so this is a chain of comparisons
    binned = []
    for f in features:
        step = F.lit(0)
        for c in cuts[f].values():
            if c is not None and not math.isnan(c):
                step = step + F.when(F.col(f) > F.lit(c), 1).otherwise(0)
        binned.append(F.struct(F.lit(f).alias("feature"), F.when(F.col(f).isNotNull(), step).alias("bin")))
    long = values.select("__now", F.inline(F.array(*binned))).filter("bin IS NOT NULL")
    counted = long.groupBy("feature", "bin").agg(
        F.count_if(~F.col("__now")).alias("base"), F.count_if("__now").alias("now")
    )
    totals = counted.groupBy("feature").agg(F.sum("base").alias("bases"), F.sum("now").alias("nows"))
    share = counted.join(F.broadcast(totals), "feature").selectExpr(
        "feature", f"greatest(base / bases, {floor}D) AS p", f"greatest(now / nows, {floor}D) AS q"
    )
    return share.groupBy("feature").agg(F.sum(F.expr("(q - p) * ln(q / p)")).alias("psi"))


SKETCH_K = 4096  # a rank read from a sketch is off by about 0.1 % of the rows at most; up to so many rows by nothing


def day_sketches(df: DataFrame, features, time: str = "transaction_date", k: int = SKETCH_K) -> DataFrame:
    """(day, feature, n, sketch): a mergeable quantile sketch of each feature's known values per day, in one aggregate.

    To be stored, one folder per day: any two periods are compared from them by :func:`drift_between`, without the rows.
    Rows without a time belong to no day.
    """
    features = list(features)
    values = df.select(F.to_date(time).alias("day"), *[number(df, f).alias(f"x{n}") for n, f in enumerate(features)])
    aggs = []
    for n in range(len(features)):
        aggs += [F.count(f"x{n}").alias(f"n{n}"), F.kll_sketch_agg_double(f"x{n}", F.lit(k)).alias(f"s{n}")]
    wide = values.where("day IS NOT NULL").groupBy("day").agg(*aggs)
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"n{n}").alias("n"), F.col(f"s{n}").alias("sketch")) for n, f in enumerate(features)]
    return wide.select("day", F.inline(F.array(*rows))).where("n > 0")


def drift_between(sketches: DataFrame, base, now, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """(feature, n_base, n_now, psi) of two periods, which are conditions on the column ``day`` of :func:`day_sketches`.

    Bins are cut at the base period's quantiles as the sketches tell them. A period may be any set of days, and the
    two may overlap. ``psi`` is null where a period has no values.
    """

    def whole(period, name):
        # days and features: few rows, whatever the table's size
        found = sketches.where(period).groupBy("feature")
        return found.agg(F.sum("n").alias(f"n_{name}"), F.kll_merge_agg_double("sketch").alias(name))

    both = whole(base, "base").join(whole(now, "now"), "feature", "full")
    there = F.col("base").isNotNull() & F.col("now").isNotNull()
    probs = F.array(*[F.lit(j / bins) for j in range(1, bins)])
    # a few cut values per feature; a rank is asked for constants only
    told = both.where(there).select("feature", F.array_distinct(F.kll_sketch_get_quantile_double("base", probs)).alias("cuts"))
    cuts = {r["feature"]: r["cuts"] for r in told.collect()}
    for name in ("base", "now"):
        ranks = F.lit(None).cast("array<double>")
        for feature, values in cuts.items():
            found = F.kll_sketch_get_rank_double(name, F.array(*[F.lit(float(v)) for v in values]))
            ranks = F.when(there & (F.col("feature") == feature), found).otherwise(ranks)
        both = both.withColumn(f"r_{name}", ranks)
    share = "transform(sequence(0, size(r_{0})), j -> coalesce(get(r_{0}, j), 1D) - coalesce(get(r_{0}, j - 1), 0D))"
    both = both.withColumns({f"p_{name}": F.expr(share.format(name)) for name in ("base", "now")})
    # a bin that neither period has rows in says nothing
    terms = f"""transform(filter(arrays_zip(p_base, p_now), b -> b.p_base > 0 OR b.p_now > 0),
        b -> (greatest(b.p_now, {floor}D) - greatest(b.p_base, {floor}D)) * ln(greatest(b.p_now, {floor}D) / greatest(b.p_base, {floor}D)))"""
    psi = F.when(there, F.expr(f"aggregate({terms}, 0D, (a, x) -> a + x)"))
    return both.select("feature", F.coalesce("n_base", F.lit(0)).alias("n_base"), F.coalesce("n_now", F.lit(0)).alias("n_now"), psi.alias("psi"))


def metrics_per_day(
    df: DataFrame, time="transaction_date", label="label", prediction="prediction", score="score",
    policy: ScalePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Threshold and ranking metrics per day of scored rows."""
    dated = df.withColumn("day", F.to_date(time))
    at = threshold_metrics(dated, label, prediction, ["day"])
    ranked = ranking_metrics(dated, label, score, by="day", policy=policy).withColumnRenamed("day", "__day")
    # rows without a time have a day of their own: null
    return at.join(ranked, F.col("day").eqNullSafe(F.col("__day")), "left").drop("__day")
