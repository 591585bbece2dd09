"""Rolling aggregates over ``[t - w, t)`` per key, for any number of windows in one pass.

Spark evaluates a sliding RANGE frame by going through the frame again for each row, which is
quadratic for busy keys. Here every row becomes one *enter* event at its time ``t`` and one
*leave* event at ``t + w`` per window. Then

    rolling(t) = sum of entered values before t  -  sum of left values before t

is a plain running total, linear in the number of events, for all windows, measures and
aggregates at once: one exchange on the key and one sort. Only the enter event carries the
payload row, so nothing has to be joined back. Values are whole numbers (cents, counts,
labels), so the differences are exact.

Hot keys are cut into ordered chunks (``plans.chunks``). Rows without a key or a time get null
features and are spread over the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_POLICY, ScalePolicy
from ..functions.scalars import window_label, window_micros
from ..plans.chunks import LONG_MAX, ChunkPlan, plan_chunks

AGGREGATES = ("count", "sum", "mean")

# Spark SQL text: building hundreds of Column objects from Python is slower than running them.
_GROUP = "PARTITION BY __k, __chunk"
_EARLIER = f"({_GROUP} ORDER BY __t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_BEFORE = f"({_GROUP} ORDER BY __t, __i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_CHUNKS_BEFORE = "(PARTITION BY __hot ORDER BY __chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_VALID = "(__k IS NOT NULL AND __t IS NOT NULL)"


@dataclass(frozen=True)
class Measure:
    """A whole-number column to roll up: ``outputs`` maps an aggregate to a name prefix."""

    column: str  # bigint column of the prepared frame
    outputs: dict  # e.g. {"count": "user_txn_count", "sum": "user_amount_sum"}
    scale: int = 1  # results are divided by this (100 for cents)
    delay: int = 0  # microseconds until the value becomes visible


@dataclass(frozen=True)
class History:
    """Per-row look at the strictly earlier rows of the key, in (time, id) order."""

    value: str  # double column
    zscore: str  # output names
    recency: str


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def roll(
    df: DataFrame,
    key: str,
    t: str,
    i: str,
    windows,
    measures,
    history: History | None = None,
    plan: ChunkPlan | None = None,
    source: DataFrame | None = None,
    policy: ScalePolicy = DEFAULT_POLICY,
    last: int | None = None,
    older: DataFrame | None = None,
    keep=None,
    past: DataFrame | None = None,
    since: int | None = None,
) -> DataFrame:
    """``df`` with the rolling columns of ``measures`` and, optionally, the history columns.

    ``t`` is a bigint column of microseconds, ``i`` a bigint tie-breaker. ``source`` is a
    cheap frame with the same keys, times and measures from which the totals of hot keys are
    taken (default: ``df``); give the stored table when ``df`` already carries other windows.
    ``last`` is the greatest ``t`` if known: later leave events are not made at all.
    ``older`` (``k, n, mean, m2, last_t, lo, hi`` per key) sums up rows that precede all of ``df``.
    ``keep`` names the columns to carry along (default: all). They travel as one struct, which
    is a single empty slot in leave events, as long as all of them are read afterwards.
    ``past`` (key, ``t``, ``i`` and measure columns) holds rows before ``since``, all rows of ``df`` are at or after it. They are
    not rolled again: per key their totals at ``since`` are one event, and they leave a window if that happens from then on.
    """
    windows = [(window_label(w), window_micros(w)) for w in windows]
    for m in measures:
        unknown = set(m.outputs) - set(AGGREGATES)
        if unknown:
            raise ValueError(f"unknown rolling aggregates {sorted(unknown)}; use {AGGREGATES}")
    source, keep = df if source is None else source, list(keep or df.columns)
    plan = plan_chunks(source, key, t, i, policy) if plan is None else plan

    before = () if past is None else _past_events(past, key, t, windows, measures, history, last, since)
    events = _with_past(_events(df, key, t, i, windows, measures, history, last, payload=keep), before)
    events = plan.attach(events, "__k", "__t", "__i", where=_VALID)

    totals = _running_totals(windows, measures)
    if before:
        totals = {name: f"IF(__open IS NULL, {x}, __open.{name})" for name, x in totals.items()}
    if history:
        # this (t, i) order also satisfies the order by t below: one sort serves both
        events = events.selectExpr(
            "*",
            f"cast(count(__h) OVER {_BEFORE} AS double) AS __hn",
            f"avg(__h) OVER {_BEFORE} AS __hmean",
            f"var_pop(__h) OVER {_BEFORE} AS __hvar",
            f"last(IF(__kind = 0, __t, NULL), true) OVER {_BEFORE} AS __hlast",
            # all earlier values are equal just when these two are; a rounded deviation cannot tell
            f"min(__h) OVER {_BEFORE} AS __hlo",
            f"max(__h) OVER {_BEFORE} AS __hhi",
        )
    if totals:
        events = events.selectExpr(
            "*", *[f"coalesce(sum({x}) OVER {_EARLIER}, 0L) AS {name}" for name, x in totals.items()]
        )
    rows = events.filter("__kind = 0")
    if not plan.empty:
        again = _with_past(_events(source, key, t, i, windows, measures, history, last, payload=None), before)
        hot = plan.only_hot(again, "__k")
        rows = _add_carry(rows, plan.located(hot, "__t", "__i"), plan, totals, history)
    if history and older is not None:
        rows = _add_older(rows, older)
    return _outputs(rows, keep, windows, measures, history)


def _events(df, key, t, i, windows, measures, history, last, payload) -> DataFrame:
    """Enter event (kind 0), leave events (kind 1..n), late-value events (kind -d)."""
    t, key, i = quoted(t), quoted(key), quoted(i)
    delays = sorted({m.delay for m in measures if m.delay > 0})
    others = [(w, n) for n, (_, w) in enumerate(windows, start=1)] if measures else []
    others += [(d, -n) for n, d in enumerate(delays, start=1)] if windows else []
    kinds = ", ".join(f"struct({n} AS kind, {shift}L AS shift)" for shift, n in [(0, 0), *sorted(others)])
    # sorted by shift, so the events up to the last instant are a prefix of the constant array
    in_time = " + ".join(f"IF({t} + {shift}L <= {last}L, 1, 0)" for shift, _ in others) if last is not None else ""
    count = f"1 + {in_time}" if others and in_time else str(1 + len(others))
    kinds = f"slice(array({kinds}), 1, IF({key} IS NOT NULL AND {t} IS NOT NULL, {count}, 1))"
    first = [f"{key} AS __k", f"{t} AS __t0", f"{i} AS __i0", f"explode({kinds}) AS __e"]
    first += [f"{quoted(m.column)} AS __m{n}" for n, m in enumerate(measures)]
    # a leave event belongs to the last chunk of its instant
    second = [
        "__k",
        "__e.kind AS __kind",
        "__t0 + __e.shift AS __t",
        f"IF(__e.kind = 0, __i0, {LONG_MAX - 1}L) AS __i",
        *[f"__m{n}" for n in range(len(measures))],
    ]
    if history:
        first.append(f"{quoted(history.value)} AS __h0")
        second.append("IF(__e.kind = 0, __h0, NULL) AS __h")
    if payload:
        first.append("struct(" + ", ".join(quoted(c) for c in payload) + ") AS __row0")
        second.append("IF(__e.kind = 0, __row0, NULL) AS __row")
    return df.selectExpr(*first).selectExpr(*second)


def _past_events(past, key, t, windows, measures, history, last, since) -> tuple:
    """Of rows before ``since``: their events from then on, and one event per key with its totals until then."""
    past = past.filter(F.col(key).isNotNull() & F.col(t).isNotNull())
    t, key = quoted(t), quoted(key)
    delays = sorted({m.delay for m in measures if m.delay > 0}) if windows else []
    others = [(w, n) for n, (_, w) in enumerate(windows, start=1)] if measures else []
    others = sorted(others + [(d, -n) for n, d in enumerate(delays, start=1)])
    if not others:
        return ()
    kinds = ", ".join(f"struct({n} AS kind, {shift}L AS shift)" for shift, n in others)
    gone = " + ".join(f"IF({t} + {shift}L < {since}L, 1, 0)" for shift, _ in others)
    come = " + ".join(f"IF({t} + {shift}L <= {last}L, 1, 0)" for shift, _ in others) if last is not None else str(len(others))
    values = [f"{quoted(m.column)} AS __m{n}" for n, m in enumerate(measures)]
    # sorted by shift, so these events are a piece of the constant array
    kinds = f"slice(array({kinds}), 1 + {gone}, greatest(0, {come} - ({gone})))"
    leaves = past.selectExpr(f"{key} AS __k", f"{t} AS __t0", *values, f"explode({kinds}) AS __e").selectExpr(
        "__k", "__e.kind AS __kind", "__t0 + __e.shift AS __t", f"{LONG_MAX - 1}L AS __i", *[f"__m{n}" for n in range(len(measures))]
    )
    sums = {}
    for w, (_, length) in enumerate(windows, start=1):
        inside = f"{t} >= {since - length}L"
        for n, m in enumerate(measures):
            if m.delay >= length:
                continue
            seen = f"{inside} AND {t} < {since - m.delay}L"
            value = quoted(m.column)
            sums[f"__n{n}_{w}"] = f"count_if({value} IS NOT NULL AND {seen})"
            if {"sum", "mean"} & set(m.outputs):
                sums[f"__s{n}_{w}"] = f"coalesce(sum(IF({seen}, {value}, NULL)), 0L)"
        if any("count" in m.outputs for m in measures):
            sums[f"__r_{w}"] = f"count_if({inside})"
    found = past.groupBy(F.expr(key).alias("__k")).agg(*[F.expr(x).alias(name) for name, x in sums.items()])
    opening = found.selectExpr(
        "__k", f"{len(others) + 1} AS __kind", f"{since - 1}L AS __t", f"{LONG_MAX - 1}L AS __i",
        f"struct({', '.join(sums)}) AS __open",
    )
    return leaves, opening


def _with_past(events: DataFrame, before: tuple) -> DataFrame:
    for part in before:
        events = events.unionByName(part, allowMissingColumns=True)
    return events


def _running_totals(windows, measures) -> dict:
    """Signed contribution of an event to each running total, by column name."""
    delays = sorted({m.delay for m in measures if m.delay > 0})
    totals = {}
    for w, (_, length) in enumerate(windows, start=1):
        for n, m in enumerate(measures):
            if m.delay >= length:
                continue
            enters = -(delays.index(m.delay) + 1) if m.delay else 0
            # rows of the other kinds contribute null, which sum() skips
            totals[f"__n{n}_{w}"] = f"CASE WHEN __m{n} IS NULL THEN NULL {_signed('1L', enters, w)}"
            if {"sum", "mean"} & set(m.outputs):
                totals[f"__s{n}_{w}"] = f"CASE {_signed(f'__m{n}', enters, w)}"
        if any("count" in m.outputs for m in measures):
            totals[f"__r_{w}"] = f"CASE {_signed('1L', 0, w)}"
    return totals


def _signed(value: str, enters: int, leaves: int) -> str:
    return f"WHEN __kind = {enters} THEN {value} WHEN __kind = {leaves} THEN -{value} END"


def _add_carry(rows, hot, plan, totals, history) -> DataFrame:
    """Add what lies before each chunk of a hot key.

    ``hot`` holds the events of hot keys only. Its per-chunk totals are combined map-side,
    and the result has at most ``plan.chunk_count`` rows.
    """
    aggs = [F.expr(f"coalesce(sum({x}), 0L)").alias(name) for name, x in totals.items()]
    if history:
        aggs += [
            F.expr("cast(count(__h) AS double)").alias("__hn"),
            F.expr("avg(__h)").alias("__hmean"),
            F.expr("var_pop(__h)").alias("__hvar"),
            F.expr("max(IF(__kind = 0, __t, NULL))").alias("__hlast"),
            F.expr("min(__h)").alias("__hlo"),
            F.expr("max(__h)").alias("__hhi"),
        ]
    sums = hot.groupBy("__hot", "__chunk").agg(*(aggs or [F.expr("count(*)").alias("__rows")]))
    carry = plan.gates().join(sums, ["__hot", "__chunk"], "left")
    if history:
        whole = "(PARTITION BY __hot ORDER BY __chunk ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        carry = carry.selectExpr("*", f"first(__hmean, true) OVER {whole} AS __origin")
    carry = carry.selectExpr(
        "__hot",
        "__chunk",
        "__gate",
        *[f"coalesce(sum({name}) OVER {_CHUNKS_BEFORE}, 0L) AS {name}_c" for name in totals],
        *(_merged_moments() if history else []),
    )
    own = ["__hn_c", "__hmean_c", "__hm2_c", "__hlast_c", "__hlo_c", "__hhi_c"] if history else []
    gated = carry.selectExpr("__hot AS __gk", "__chunk AS __gc", *[f"{n}_c" for n in totals])
    carry = (
        carry.drop(*[f"{n}_c" for n in totals])
        .join(gated, F.expr("__hot = __gk AND __gate = __gc"))
        .selectExpr("__hot AS __ck", "__chunk AS __cc", *[f"{n}_c" for n in totals], *own)
    )
    joined = rows.join(F.broadcast(carry), F.expr("__k = __ck AND __chunk = __cc"), "left")
    changed = {n: f"{n} + coalesce({n}_c, 0L)" for n in totals}
    if history:
        changed.update(_moment_updates())
    kept = [c for c in rows.columns if c not in changed]
    return joined.selectExpr(*kept, *[f"{x} AS {n}" for n, x in changed.items()])


def _moment_updates() -> dict:
    """The history columns merged with those of earlier rows (suffix ``_c``)."""
    n0, both = "coalesce(__hn_c, 0D)", "coalesce(__hn_c, 0D) > 0 AND __hn > 0"
    gap = "(__hmean - __hmean_c)"
    m2 = "coalesce(__hvar * __hn, 0D) + coalesce(__hm2_c, 0D)"
    merged = f"IF({both}, {gap} * {gap} * {n0} * __hn / ({n0} + __hn), 0D)"
    return {
        "__hn": f"{n0} + __hn",
        "__hmean": f"IF({both}, __hmean_c + {gap} * __hn / ({n0} + __hn), coalesce(__hmean, __hmean_c))",
        "__hvar": f"IF({n0} + __hn > 0, ({m2} + {merged}) / ({n0} + __hn), NULL)",
        "__hlast": "coalesce(__hlast, __hlast_c)",
        "__hlo": "least(__hlo, __hlo_c)",
        "__hhi": "greatest(__hhi, __hhi_c)",
    }


def _add_older(rows, older) -> DataFrame:
    """Merge moments of rows that are no longer in the frame, one row per key."""
    named = older.selectExpr(
        "k AS __ok",
        "n AS __hn_c",
        "mean AS __hmean_c",
        "m2 AS __hm2_c",
        "last_t AS __hlast_c",
        "lo AS __hlo_c",
        "hi AS __hhi_c",
    )
    changed = _moment_updates()
    kept = [c for c in rows.columns if c not in changed]
    # one row per key: their number goes by the input, so they are not left to a broadcast
    joined = rows.join(named.hint("merge"), F.expr("__k = __ok"), "left")
    return joined.selectExpr(*kept, *[f"{x} AS {n}" for n, x in changed.items()])


def _merged_moments() -> list:
    """Count, mean and squared deviations of all earlier chunks, from running sums.

    Means are taken relative to the first one of the key (``__origin``), which keeps the sums
    small and little affected by rounding.
    """
    d = "(__hmean - __origin)"
    n = f"sum(__hn) OVER {_CHUNKS_BEFORE}"
    s1 = f"sum(__hn * {d}) OVER {_CHUNKS_BEFORE}"
    s2 = f"sum(__hn * (__hvar + {d} * {d})) OVER {_CHUNKS_BEFORE}"
    return [
        f"coalesce({n}, 0D) AS __hn_c",
        f"__origin + try_divide({s1}, {n}) AS __hmean_c",
        f"greatest({s2} - try_divide({s1} * {s1}, {n}), 0D) AS __hm2_c",
        f"max(__hlast) OVER {_CHUNKS_BEFORE} AS __hlast_c",
        f"min(__hlo) OVER {_CHUNKS_BEFORE} AS __hlo_c",
        f"max(__hhi) OVER {_CHUNKS_BEFORE} AS __hhi_c",
    ]


def _outputs(rows, columns, windows, measures, history) -> DataFrame:
    out = [f"__row.{quoted(c)} AS {quoted(c)}" for c in columns]
    if history:
        sd = "sqrt(__hvar * __hn / (__hn - 1))"
        out.append(f"IF({_VALID}, (__t - __hlast) / 1e6D, NULL) AS {quoted(history.recency)}")
        out.append(
            f"IF({_VALID} AND __hlo < __hhi AND __hvar > 0, (__h - __hmean) / {sd}, NULL) AS {quoted(history.zscore)}"
        )
    for w, (label, length) in enumerate(windows, start=1):
        for n, m in enumerate(measures):
            seen, top = f"__n{n}_{w}", f"__s{n}_{w}"
            for agg, prefix in m.outputs.items():
                if agg == "count":
                    value = f"IF({_VALID} AND __r_{w} > 0, {seen if m.delay < length else '0L'}, NULL)"
                elif m.delay >= length:
                    value = "cast(NULL AS double)"
                else:
                    result = f"{top} / {m.scale}D" if agg == "sum" else f"{top} / {seen} / {m.scale}D"
                    value = f"IF({_VALID} AND {seen} > 0, {result}, NULL)"
                out.append(f"{value} AS {quoted(f'{prefix}_{label}')}")
    return rows.selectExpr(*out)
