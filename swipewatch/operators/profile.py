"""Data profiles: null counts, summaries, correlations, histograms, box-plot figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_POLICY, ScalePolicy
from ..functions.scalars import hash_fraction_key, is_missing, number
from ..plans.ranks import quantiles


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def column_roles(df: DataFrame) -> tuple:
    """``(numeric, categorical)`` column names: numbers and booleans, and all others."""
    numeric = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    return numeric, [c for c in df.columns if c not in numeric]


def _stack(wide: DataFrame, pairs, names) -> DataFrame:
    return wide.selectExpr(f"stack({len(pairs)}, {', '.join(pairs)}) AS ({', '.join(names)})")


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: type, role, rows and missing values, in one pass over the data."""
    numeric, _ = column_roles(df)
    aggs = [F.count("*").alias("rows")]
    aggs += [F.count_if(is_missing(df, c)).alias(f"m{n}") for n, c in enumerate(df.columns)]
    pairs = []
    for n, f in enumerate(df.schema.fields):
        role = "numeric" if f.name in numeric else "categorical"
        pairs.append(f"'{f.name}', '{f.dataType.simpleString()}', '{role}', rows, m{n}")
    return _stack(df.agg(*aggs), pairs, ["column", "dtype", "role", "rows", "missing"])


def _constant(value) -> Column:
    """A learned number as an aggregate over all rows; infinity and null included."""
    return F.first(F.lit(value).cast("double"))


def describe(df: DataFrame, columns=None, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per numeric column."""
    columns = list(columns or column_roles(df)[0])
    values = df.select(*[number(df, c).alias(c) for c in columns])
    cuts = quantiles(values, columns, [0.25, 0.5, 0.75], policy)
    aggs = []
    for n, c in enumerate(columns):
        aggs += [F.count(c).alias(f"n{n}"), F.avg(c).alias(f"a{n}"), F.stddev_samp(c).alias(f"s{n}"),
                 F.min(c).alias(f"l{n}"), F.max(c).alias(f"h{n}")]
        aggs += [_constant(v).alias(f"q{n}_{k}") for k, v in enumerate(cuts[c].values())]
    pairs = [f"'{c}', n{n}, a{n}, s{n}, l{n}, q{n}_0, q{n}_1, q{n}_2, h{n}" for n, c in enumerate(columns)]
    return _stack(values.agg(*aggs), pairs, ["column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"])


def correlation(df: DataFrame, columns=None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, one aggregate pass.

    A pair uses the rows in which both values are present.
    """
    columns = list(columns or column_roles(df)[0])
    values = df.select(*[number(df, c).alias(c) for c in columns])
    pairs = [(a, b) for a in range(len(columns)) for b in range(a, len(columns))]
    wide = values.agg(*[F.corr(columns[a], columns[b]).alias(f"r{a}_{b}") for a, b in pairs])
    listed = [f"'{columns[a]}', '{columns[b]}', r{min(a, b)}_{max(a, b)}" for a in range(len(columns))
              for b in range(len(columns))]
    return _stack(wide, listed, ["x", "y", "corr"])


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts in ``bins`` equal steps of ``[low, high]``; the last includes ``high``.

    Without bounds these are the smallest and the greatest value; then the counts sum to all rows
    with a value. With a bound given, bin -1 counts what lies below and bin ``bins`` what lies
    above. Every bin has a row. A single value makes one step of width one; infinite values lie
    beyond any bounds; without finite values there are no rows.
    """
    x = number(df, column)
    finite = F.abs(x) < float("inf")
    if low is None or high is None:
        ends = df.agg(F.min(F.when(finite, x)), F.max(F.when(finite, x))).first()
        if ends[0] is None:
            return df.sparkSession.createDataFrame([], "bin int, bin_start double, n long")
        low = ends[0] if low is None else low
        high = ends[1] if high is None else high
        high = high if high > low else low + 1.0
    if bins < 1 or not low < high:
        raise ValueError("need at least one bin and low < high")
    width = (high - low) / bins
    inner = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    bin_ = F.when(x < low, -1).when(x > high, bins).otherwise(inner)
    counted = df.filter(x.isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(-1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    joined = every.join(F.broadcast(counted), "bin", "left")  # at most one row per bin
    start = F.when(F.col("bin") < 0, F.lit(float("-inf"))).otherwise(F.lit(low) + F.col("bin") * F.lit(width))
    return joined.select("bin", start.alias("bin_start"), F.coalesce("n", F.lit(0)).alias("n"))


def box_stats(df: DataFrame, columns=None, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Quartiles, whisker ends within 1.5 quartile ranges, and the number of rows beyond."""
    columns = list(columns or column_roles(df)[0])
    values = df.select(*[number(df, c).alias(c) for c in columns])
    cuts = quantiles(values, columns, [0.25, 0.5, 0.75], policy)
    aggs, pairs = [], []
    for n, c in enumerate(columns):
        q1, q2, q3 = cuts[c].values()
        # without a finite spread (all null, or an infinite quartile) nothing is an outlier
        spread = 0.0 if q1 is None else q3 - q1
        fenced = q1 is not None and math.isfinite(spread)
        x = F.col(c)
        inside = x.between(q1 - 1.5 * spread, q3 + 1.5 * spread) if fenced else x.isNotNull()
        aggs += [F.min(F.when(inside, x)).alias(f"l{n}"), F.max(F.when(inside, x)).alias(f"h{n}"),
                 F.count_if(~inside).alias(f"o{n}")]
        aggs += [_constant(v).alias(f"q{n}_{k}") for k, v in enumerate((q1, q2, q3))]
        pairs.append(f"'{c}', q{n}_0, q{n}_1, q{n}_2, l{n}, h{n}, o{n}")
    return _stack(values.agg(*aggs), pairs, ["column", "q25", "q50", "q75", "whisker_low", "whisker_high", "outliers"])


def sample_by_label(df: DataFrame, label: str, k: int, id_: str, seed: int = 42) -> DataFrame:
    """``k`` rows of each label value, all of them if there are fewer, for plots of single points.

    Those with the smallest hashes of id and seed: the same rows on any partitioning, and a sample of the union of two
    tables comes from their samples. Tasks pass on no more than ``k`` rows per value.
    """
    taken = set(df.columns)
    place = next(n for n in ("place", "__place", "___place") if n not in taken)
    order = Window.partitionBy(label).orderBy(hash_fraction_key(F.col(id_), seed), F.col(id_))
    return df.withColumn(place, F.row_number().over(order)).where(F.col(place) <= k).drop(place)


def by_label(df: DataFrame, label: str, columns=None) -> DataFrame:
    """Count, mean, deviation, minimum and maximum per label value and numeric column."""
    columns = [c for c in (columns or column_roles(df)[0]) if c != label]
    values = df.select(F.col(label), *[number(df, c).alias(c) for c in columns])
    aggs = []
    for n, c in enumerate(columns):
        aggs += [F.count(c).alias(f"n{n}"), F.avg(c).alias(f"a{n}"), F.stddev_samp(c).alias(f"s{n}"),
                 F.min(c).alias(f"l{n}"), F.max(c).alias(f"h{n}")]
    pairs = [f"'{c}', n{n}, a{n}, s{n}, l{n}, h{n}" for n, c in enumerate(columns)]
    stacked = f"stack({len(columns)}, {', '.join(pairs)}) AS (column, count, mean, std, min, max)"
    return values.groupBy(label).agg(*aggs).selectExpr(label, stacked)
