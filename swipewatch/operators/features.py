"""The behavioural features of a transaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_POLICY, ScalePolicy, TxnConfig
from ..functions.scalars import as_timestamp, cents, micros, number, window_micros
from ..plans.chunks import plan_chunks_for, tie_key
from .rolling import History, Measure, roll

_T, _I, _C, _L, _A = "__time_us", "__tie", "__cents", "__label", "__amount"
_HELPERS = (_T, _I, _C, _L, _A)


def prepare(df: DataFrame, cfg: TxnConfig) -> DataFrame:
    """Parse the time column and add the helper columns the rolling operators read."""
    df = df.withColumn(cfg.time, as_timestamp(df, cfg.time, cfg.on_bad_time, cfg.time_formats))
    amount = number(df, cfg.amount)
    label = number(df, cfg.label).cast("bigint") if cfg.label in df.columns else F.lit(None).cast("bigint")
    return df.withColumns(
        {
            _T: micros(F.col(cfg.time)),
            _I: tie_key(df, cfg.id),
            _A: amount,
            _C: cents(amount),
            _L: label,
        }
    )


def _measures(cfg: TxnConfig, family: str, has_label: bool) -> list:
    delay = window_micros(cfg.label_delay) if cfg.label_delay else 0
    if family == "user":
        names = {"count": "user_txn_count", "sum": "user_amount_sum", "mean": "user_amount_mean"}
        return [Measure(_C, names, scale=100)]
    if family == "merchant":
        found = [Measure(_C, {"count": "merchant_txn_count", "mean": "merchant_amount_mean"}, scale=100)]
        if has_label:
            found.append(Measure(_L, {"mean": "merchant_fraud_rate"}, delay=delay))
        return found
    return [Measure(_C, {"count": f"{family}_txn_count"})]


def _family(df, source, cfg, family, plan, last, has_label, older, keep, past, since):
    key = getattr(cfg, family)
    history = History(_A, "user_amount_zscore", "user_time_since_last_txn") if family == "user" else None
    return roll(
        df,
        key,
        _T,
        _I,
        cfg.windows,
        _measures(cfg, family, has_label),
        history,
        plan=plan,
        source=source,
        last=last,
        older=older if family == "user" else None,
        keep=keep,
        past=past,
        since=since,
    )


def feature_names(columns, cfg: TxnConfig) -> list:
    """Names of the columns :func:`add_features` adds to a table with these columns."""
    names = []
    if cfg.user in columns:
        names += ["user_time_since_last_txn", "user_amount_zscore"]
        for w in cfg.windows:
            names += [f"user_txn_count_{w}", f"user_amount_sum_{w}", f"user_amount_mean_{w}"]
    if cfg.merchant in columns:
        for w in cfg.windows:
            names += [f"merchant_txn_count_{w}", f"merchant_amount_mean_{w}"]
            if cfg.label in columns:
                names.append(f"merchant_fraud_rate_{w}")
    for family in ("currency", "status"):
        if getattr(cfg, family) in columns:
            names += [f"{family}_txn_count_{w}" for w in cfg.windows]
    return names


def add_features(
    df: DataFrame,
    cfg: TxnConfig = TxnConfig(),
    families=("user", "merchant", "currency", "status"),
    policy: ScalePolicy = DEFAULT_POLICY,
    older: DataFrame | None = None,
    past: DataFrame | None = None,
    since: int | None = None,
) -> DataFrame:
    """Input columns plus the features of ``families``; no row sees itself or a later row.

    Families run narrowest first, so that the wide ones are not carried through the other
    exchanges; the output is put back in the documented order. Without a time or amount
    column the input comes back unchanged. ``older`` is the summary of user rows that are no
    longer part of ``df`` (see :func:`summarize_users`). ``past`` holds rows with times before ``since`` (microseconds) that
    only windows look back to; all rows of ``df`` with a time are at or after it.
    """
    if cfg.time not in df.columns or cfg.amount not in df.columns:
        return df
    columns = df.columns
    has_label = cfg.label in columns
    base = prepare(df, cfg)
    present = [f for f in ("currency", "status", "merchant", "user") if f in families and getattr(cfg, f) in columns]
    if not present:
        return base.select(*columns)
    # one narrow pass: the size decides the plan, the last instant trims useless events
    total, last = base.agg(F.count("*"), F.max(_T)).first()
    plans = plan_chunks_for(base, [getattr(cfg, f) for f in present], _T, _I, policy, total)
    looked_at = None if past is None else prepare(past, cfg)
    out = base
    for family in present:
        # the last family has no further use for the helper columns
        keep = [c for c in out.columns if family != present[-1] or c not in _HELPERS]
        key, before = getattr(cfg, family), looked_at
        if before is not None:
            before = before.join(base.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_semi")
        out = _family(out, base, cfg, family, plans[key], last, has_label, older, keep, before, since)
    wanted = [n for n in feature_names(columns, cfg) if n in out.columns]
    return out.select(*columns, *wanted)


def summarize_users(df: DataFrame, cfg: TxnConfig, by=()) -> DataFrame:
    """Mergeable history per user: ``k, n, mean, m2, last_t, lo, hi`` (and the columns in ``by``)."""
    return (
        prepare(df, cfg)
        .filter(F.col(cfg.user).isNotNull() & F.col(_T).isNotNull())
        .groupBy(F.col(cfg.user).alias("k"), *by)
        .agg(
            F.count(_A).cast("double").alias("n"),
            F.avg(_A).alias("mean"),
            (F.var_pop(_A) * F.count(_A)).alias("m2"),
            F.max(_T).alias("last_t"),
            F.min(_A).alias("lo"),
            F.max(_A).alias("hi"),
        )
    )


def merge_summaries(df: DataFrame) -> DataFrame:
    """One summary per user out of several, from two aggregations over the small summaries."""
    means = df.groupBy("k").agg(
        F.sum("n").alias("n"),
        F.expr("try_divide(sum(n * mean), sum(n))").alias("mean"),
        F.max("last_t").alias("last_t"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    spread = (
        df.join(means.selectExpr("k", "mean AS all_mean"), "k")
        .groupBy("k")
        .agg(F.expr("sum(m2 + n * (mean - all_mean) * (mean - all_mean))").alias("m2"))
    )
    return means.join(spread, "k").select("k", "n", "mean", "m2", "last_t", "lo", "hi")
