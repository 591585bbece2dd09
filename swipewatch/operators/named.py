"""Rolling aggregates of the amount by name, each by the operator that suits it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import DEFAULT_POLICY, ScalePolicy, TxnConfig
from . import distinct, moving, order_stats, rolling
from .features import _C, _HELPERS, _I, _T, prepare

SUMS = ("count", "sum")
QUANTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p99": 0.99}
AGGREGATES = (*SUMS, *moving.AGGREGATES, *QUANTILES, "nunique")


def rolling_by_name(
    df: DataFrame, aggs, key: str, cfg: TxnConfig = TxnConfig(), prefix: str = "amount", policy: ScalePolicy = DEFAULT_POLICY
) -> DataFrame:
    """``df`` with ``{prefix}_{agg}_{window}`` for each aggregate in ``aggs`` over the rows of ``key`` in ``[t - w, t)``.

    ``nunique`` counts the different amounts. Counts are null where the window holds no row, all others where it holds no
    amount (``nunique``: no row).
    """
    if unknown := set(aggs) - set(AGGREGATES):
        raise ValueError(f"unknown aggregates {sorted(unknown)}; use {AGGREGATES}")
    columns, base = df.columns, prepare(df, cfg)
    out, names = base, {a: f"{prefix}_{a}" for a in aggs}
    if sums := {a: names[a] for a in aggs if a in SUMS}:
        out = rolling.roll(out, key, _T, _I, cfg.windows, [rolling.Measure(_C, sums, scale=100)], source=base, policy=policy)
    if merged := {a: names[a] for a in aggs if a in moving.AGGREGATES}:
        out = moving.moving(out, key, _T, _I, cfg.windows, [moving.Moving("__amount", merged)], source=base, policy=policy)
    if ranks := {names[a]: QUANTILES[a] for a in aggs if a in QUANTILES}:
        out = order_stats.rolling_quantiles(out, key, "__amount", _T, cfg.windows, ranks, policy)
    if "nunique" in aggs:
        out = distinct.rolling_distinct(out, key, "__amount", _T, _I, cfg.windows, names["nunique"], policy)
    made = [c for c in out.columns if c not in columns and c not in _HELPERS]
    by_name = sorted(made, key=lambda c: next(n for n, a in enumerate(aggs) if c.startswith(f"{names[a]}_")))
    return out.select(*columns, *by_name)
