"""Moving average, exponential average and relative strength of value series per key.

A series is the rows of one key in ``(time, id)`` order; without a key the whole table is one
series. Keys of ordinary size need one exchange. Hot keys first get exact row positions
(``plans.chunks``) and are then worked on in blocks of consecutive positions. Exponential
recurrences ``y = a*x + (1-a)*y'`` compose across blocks, so each block starts from a carry
that is computed from one aggregated number per block.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_POLICY, ScalePolicy
from ..functions.scalars import micros, number
from ..plans.chunks import ordered_sums, plan_chunks, tie_key


class _Series:
    """Rows with helper columns ``__k, __t, __i, __x`` and 0-based position ``__pos``."""

    def __init__(self, df, key, time, value, id_, policy, at_least):
        kind = df.schema[time].dataType
        t = micros(F.col(time)) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(time)
        rows = df.select(
            *df.columns,
            (F.col(key) if key else F.lit(0)).alias("__k"),
            t.cast("bigint").alias("__t"),
            tie_key(df, id_).alias("__i"),
            number(df, value).alias("__x"),
        ).filter("__k IS NOT NULL AND __t IS NOT NULL AND __x IS NOT NULL")
        self.columns = df.columns
        self.plan = plan_chunks(rows, "__k", "__t", "__i", policy)
        self.block = max(policy.chunk_limit(self.plan.total), at_least)
        self.rows = ordered_sums(rows, "__k", "__t", "__i", {"__pos": "1L"}, self.plan)

    def blocks(self, halo: int) -> DataFrame:
        """Rows with ``__block``; ``__own`` is false for the ``halo`` rows copied from before.

        Without hot keys every key is one block, and the exchange of the positions is reused.
        """
        if self.plan.empty:
            return self.rows.selectExpr("*", "0L AS __block", "true AS __own")
        home = f"__pos div {self.block}"
        if not halo:
            return self.rows.selectExpr("*", f"{home} AS __block", "true AS __own")
        # halo < block, so a row reaches its own block and at most the next one
        return self.rows.selectExpr(
            "*", f"explode(sequence({home}, (__pos + {halo}) div {self.block})) AS __block"
        ).selectExpr("*", f"__block = {home} AS __own")


def _check_window(n: int, least: int) -> None:
    if n < least:
        raise ValueError(f"window size must be at least {least}, got {n}")


def _check_length(df: DataFrame, key, n: int, total: int) -> None:
    if key is None and n > total:
        raise ValueError(f"window size {n} exceeds the series length {total}")


def moving_average(
    df: DataFrame,
    key: str | None,
    time: str,
    value: str,
    n: int,
    id_: str | None = "transaction_id",
    output: str = "moving_average",
    policy: ScalePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Mean of the last ``n`` values. The first ``n - 1`` rows of a key have none and are left out.

    Rows without key, time or value are no points of a series and are left out.
    """
    _check_window(n, 1)
    s = _Series(df, key, time, value, id_, policy, at_least=n)
    _check_length(df, key, n, s.plan.total)
    over = f"(PARTITION BY __k, __block ORDER BY __t, __i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    if s.plan.empty:  # same partitioning as the positions: no further exchange
        over = over.replace("__block", "__chunk")
    return (
        s.blocks(halo=n - 1)
        .selectExpr("*", f"avg(__x) OVER {over} AS __avg")
        .filter(f"__own AND __pos >= {n - 1}")
        .select(*s.columns, F.col("__avg").alias(output))
    )


def exponential_average(
    df: DataFrame,
    key: str | None,
    time: str,
    value: str,
    alpha: float,
    id_: str | None = "transaction_id",
    output: str = "ema",
    policy: ScalePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """``e0 = x0, e = alpha*x + (1 - alpha)*e'`` along each series.

    Rows without key, time or value are no points of a series and are left out.
    """
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"alpha must lie in [0, 1], got {alpha}")
    s = _Series(df, key, time, value, id_, policy, at_least=1)
    rows = s.blocks(halo=0).withColumn("__y0", F.col("__x"))
    return _recur(rows, s, ["__y0"], alpha, start=0).select(*s.columns, F.col("__y0").alias(output))


def relative_strength(
    df: DataFrame,
    key: str | None,
    time: str,
    value: str,
    n: int,
    id_: str | None = "transaction_id",
    output: str = "rsi",
    policy: ScalePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Relative strength index with Wilder smoothing, from the ``n``-th row of each series on.

    The first ``n - 1`` differences, summed and divided by ``n``, seed the average gain and
    loss. Without any loss the index is 100.
    Rows without key, time or value are no points of a series and are left out.
    """
    _check_window(n, 2)
    s = _Series(df, key, time, value, id_, policy, at_least=n)
    _check_length(df, key, n, s.plan.total)
    part = "__chunk" if s.plan.empty else "__block"
    order = f"(PARTITION BY __k, {part} ORDER BY __t, __i"
    rows = s.blocks(halo=1).selectExpr("*", f"__x - lag(__x) OVER {order}) AS __d").filter("__own")
    rows = rows.selectExpr("*", "greatest(__d, 0D) AS __gain", "greatest(-__d, 0D) AS __loss")
    # the seed lies in the first block, because a block has at least n rows
    sofar = f"{order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows = rows.selectExpr(
        "*",
        f"IF(__pos = {n - 1}, sum(__gain) OVER {sofar} / {n}, __gain) AS __y0",
        f"IF(__pos = {n - 1}, sum(__loss) OVER {sofar} / {n}, __loss) AS __y1",
    ).filter(f"__pos >= {n - 1}")
    out = _recur(rows, s, ["__y0", "__y1"], 1.0 / n, start=n - 1)
    index = "IF(__y1 = 0, 100D, 100D - 100D / (1D + __y0 / __y1))"
    return out.select(*s.columns, F.expr(index).alias(output))


def _recur(rows: DataFrame, s: _Series, columns, alpha: float, start: int) -> DataFrame:
    """Replace each column by its exponential recurrence along ``__pos`` from ``start`` on."""
    if s.plan.empty:
        # the window behind __pos has already put each key into one task, in this order
        first = f"__pos = {start}"
        order = ["__k", "__t", "__i"]
    else:
        rows = _with_carry(rows, s, columns, alpha, start).repartition("__k", "__block")
        first = f"__pos = {start} OR __pos % {s.block} = 0"
        order = ["__k", "__block", "__pos"]
    ordered = rows.selectExpr(
        *[f"`{c}`" for c in s.columns], *order, f"{first} AS __first", *columns
    ).sortWithinPartitions(*order)
    return ordered.mapInArrow(_smoother(columns, alpha), ordered.schema)


def _with_carry(rows, s, columns, alpha, start) -> DataFrame:
    """Fold what came before a block into the block's first value.

    With r = 1 - alpha, a full block turns a carry c into ``r**size * c + d``, where d is the
    weighted sum of the block's values: one aggregated row per block.
    """
    size, r = s.block, 1.0 - alpha
    exponent = f"(({size} - 1) - __pos % {size})"
    weight = f"power({r!r}D, {exponent}) * IF(__pos = {start}, 1D, {alpha!r}D)"
    per_block = rows.groupBy("__k", "__block").agg(
        F.count("*").alias("__n"), *[F.expr(f"sum({weight} * {c})").alias(f"{c}_d") for c in columns]
    )
    # blocks that another block follows are full; keys with a single block need no carry
    several = per_block.selectExpr("*", "max(__block) OVER (PARTITION BY __k) AS __last").filter("__last > 0")
    names = [f"{c}_d" for c in columns]
    fields = [T.StructField("__ck", rows.schema["__k"].dataType), T.StructField("__cb", T.LongType())]
    schema = T.StructType(fields + [T.StructField(f"{c}_c", T.DoubleType()) for c in columns])
    shrink = r**size if r > 0 else 0.0

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__block")
        carry, found = [0.0] * len(names), []
        for row in pdf[["__k", "__block", *names]].itertuples(index=False):
            if row[1] > 0:
                found.append((row[0], row[1], *carry))
            carry = [shrink * c + d for c, d in zip(carry, row[2:])]
        return pd.DataFrame(found, columns=[f.name for f in schema.fields])

    carries = several.groupBy("__k").applyInPandas(fold, schema)
    joined = rows.join(F.broadcast(carries), F.expr("__k = __ck AND __block = __cb"), "left")
    first = f"__pos % {size} = 0 AND __block > 0"
    changed = [f"IF({first}, {alpha!r}D * {c} + {r!r}D * {c}_c, {c}) AS {c}" for c in columns]
    return joined.selectExpr(*[f"`{c}`" for c in rows.columns if c not in columns], *changed)


def _smoother(columns, alpha):
    """Recurrence over sorted Arrow batches; only the last value is kept in between.

    The other columns of a batch pass through untouched.
    """

    def run(batches):
        last = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column("__first").to_numpy(zero_copy_only=False)
            segment = np.cumsum(first)
            arrays = dict(zip(batch.schema.names, batch.columns))
            for c in columns:
                y = batch.column(c).to_numpy(zero_copy_only=False).astype("float64")
                if not first[0]:  # goes on from the batch before
                    y[0] = alpha * y[0] + (1.0 - alpha) * last[c]
                grouped = pd.Series(y).groupby(segment, sort=False)
                smooth = grouped.ewm(alpha=alpha, adjust=False).mean() if alpha > 0.0 else grouped.transform("first")
                y = smooth.to_numpy()
                last[c], arrays[c] = y[-1], pa.array(y)
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=batch.schema.names)

    return run


def last_of_series(df: DataFrame, key: str, time: str, id_: str, value: str, output: str) -> DataFrame:
    """The latest value per key, combined map-side."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(time, id_)).alias(output))
