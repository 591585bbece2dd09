"""Rolling numbers of different values over ``[t - w, t)`` per key.

A value counts at ``t`` if its last occurrence before ``t`` lies in the window. So an occurrence at ``u`` stands for its
value from just after ``u`` until it is ``w`` old or the next occurrence takes over, whichever comes first: one event that
adds 1 at ``u`` and one per window that takes it away. The number at ``t`` is the sum of all events before ``t``, a running
total, linear in the rows for all windows together.

Occurrences of a key and value at one instant are first merged, map-side. The next occurrence is looked up per
key and value, the totals run per key; both cut what is hot into ordered chunks (``plans.chunks``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_POLICY, ScalePolicy
from ..functions.scalars import window_label, window_micros
from ..plans.chunks import LONG_MAX, plan_chunks
from .rolling import quoted

TASK_EVENTS = 500_000  # a task sorts about so many

_VALID = "__k IS NOT NULL AND __t IS NOT NULL"


def _dealt(df: DataFrame, events: int, key: str) -> DataFrame:
    """Dealt by key and chunk; more events make more tasks, not longer ones."""
    return df.repartition(max(2, -(-events // TASK_EVENTS)), key, "__chunk")


def occurrences(df: DataFrame, key: str, value: str, t: str, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """(__k, __t, __next): each instant at which a key has a value, and the next instant at which it has the same one."""
    seen = df.selectExpr(f"{quoted(key)} AS __k", f"{quoted(value)} AS __v", f"{quoted(t)} AS __t")
    seen = seen.where("__k IS NOT NULL AND __v IS NOT NULL AND __t IS NOT NULL").distinct()
    seen = seen.selectExpr("struct(__k, __v) AS __kv", "__t", "0L AS __i")
    plan = plan_chunks(seen, "__kv", "__t", "__i", policy)
    order = "PARTITION BY __kv, __chunk ORDER BY __t"
    out = _dealt(plan.attach(seen, "__kv", "__t", "__i"), plan.total, "__kv").selectExpr("*", f"lead(__t) OVER ({order}) AS __next")
    if not plan.empty:
        hot = plan.located(plan.only_hot(seen, "__kv"), "__t", "__i")
        firsts = hot.groupBy("__hot", "__chunk").agg(F.min("__t").alias("__first"))
        # the first occurrence in a later chunk; as few rows as there are cut points
        later = "PARTITION BY __hot ORDER BY __chunk DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        after = firsts.selectExpr("__hot AS __ck", "__chunk AS __cc", f"min(__first) OVER ({later}) AS __after")
        out = out.join(F.broadcast(after), F.expr("__kv = __ck AND __chunk = __cc"), "left")
        out = out.withColumn("__next", F.expr("coalesce(__next, __after)"))
    return out.selectExpr("__kv.__k AS __k", "__t", "__next")


def rolling_distinct(
    df: DataFrame,
    key: str,
    value: str,
    t: str,
    i: str,
    windows,
    prefix: str,
    policy: ScalePolicy = DEFAULT_POLICY,
    keep=None,
) -> DataFrame:
    """``df`` with ``{prefix}_{window}``: how many different ``value``s the key's rows in the window have.

    Null values are no values. The number is null where the window holds no row at all, and for rows without key or time.
    """
    windows, keep = [(window_label(w), window_micros(w)) for w in windows], list(keep or df.columns)
    steps = [f"struct(__t AS t, {', '.join(f'1L AS d{n}' for n in range(len(windows)))})"]
    for n, (_, w) in enumerate(windows):
        change = ", ".join(f"{-1 if m == n else 0}L AS d{m}" for m in range(len(windows)))
        steps.append(f"struct(least(__t + {w}L, coalesce(__next, {LONG_MAX}L)) AS t, {change})")
    events = occurrences(df, key, value, t, policy).selectExpr("__k", f"inline(array({', '.join(steps)}))")
    # rows of any value keep a window from being empty: they come in and leave as one more kind of event
    rows_in = ", ".join(["struct(__t AS t, 1L AS n, -1 AS w)", *[f"struct(__t + {w}L AS t, -1L AS n, {m} AS w)" for m, (_, w) in enumerate(windows)]])
    present = df.selectExpr(f"{quoted(key)} AS __k", f"{quoted(t)} AS __t").where(_VALID).distinct()
    present = present.selectExpr("__k", f"inline(array({rows_in}))")
    counts = [f"IF(w IN (-1, {m}), n, 0L) AS r{m}" for m in range(len(windows))]
    names = [f"d{m}" for m in range(len(windows))] + [f"r{m}" for m in range(len(windows))]
    nothing = F.lit(0).cast("long")
    changes = events.select("__k", F.col("t").alias("__t"), *[c if c[0] == "d" else nothing.alias(c) for c in names]).unionByName(
        present.selectExpr("__k", "t AS __t", *[f"0L AS d{m}" for m in range(len(windows))], *counts)
    )
    narrow = df.selectExpr(f"{quoted(key)} AS __k", f"{quoted(t)} AS __t", f"{quoted(i)} AS __i")
    plan = plan_chunks(narrow, "__k", "__t", "__i", policy)
    if not plan.empty:
        # nobody asks after a key's last row; of a hot key the last chunk would hold all that leaves after it
        ends = plan.only_hot(narrow, "__k").groupBy("__hot").agg(F.max("__t").alias("__end"))
        changes = changes.join(F.broadcast(ends), F.expr("__k = __hot"), "left").where("__end IS NULL OR __t < __end").drop("__hot", "__end")
    # one event per key and instant
    changes = changes.groupBy("__k", "__t").agg(*[F.sum(c).alias(c) for c in names])
    payload = f"struct({', '.join(quoted(c) for c in keep)})"
    asking = df.selectExpr(f"{quoted(key)} AS __k", f"{quoted(t)} AS __t", f"{quoted(i)} AS __i", f"{payload} AS __row")
    # at one instant all rows ask before anything changes
    told = changes.withColumn("__i", F.lit(LONG_MAX - 1)).withColumn("__row", F.lit(None).cast(asking.schema["__row"].dataType))
    for c in names:
        asking = asking.withColumn(c, nothing)
    both = asking.unionByName(told)
    before = "(PARTITION BY __k, __chunk ORDER BY __t, __i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    # a row asks, and is at most as many changes as there are windows and one, for itself and for its value
    out = _dealt(plan.attach(both, "__k", "__t", "__i", where=f"({_VALID})"), plan.total * (3 + 2 * len(windows)), "__k")
    out = out.selectExpr("__k", "__t", "__chunk", "__row", *[f"coalesce(sum({c}) OVER {before}, 0L) AS {c}" for c in names])
    out = out.where("__row IS NOT NULL")
    if not plan.empty:
        hot = plan.located(plan.only_hot(changes.withColumn("__i", F.lit(LONG_MAX - 1)), "__k"), "__t", "__i")
        totals = hot.groupBy("__hot", "__chunk").agg(*[F.sum(c).alias(c) for c in names])
        earlier = "(PARTITION BY __hot ORDER BY __chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        carry = plan.gates().join(totals, ["__hot", "__chunk"], "left").selectExpr(
            "__hot AS __ck", "__chunk AS __cc", *[f"coalesce(sum({c}) OVER {earlier}, 0L) AS {c}_c" for c in names]
        )
        out = out.join(F.broadcast(carry), F.expr("__k = __ck AND __chunk = __cc"), "left")
        out = out.selectExpr("__k", "__t", "__row", *[f"{c} + coalesce({c}_c, 0L) AS {c}" for c in names])
    results = [f"IF({_VALID} AND r{m} > 0, d{m}, NULL) AS {quoted(f'{prefix}_{label}')}" for m, (label, _) in enumerate(windows)]
    return out.selectExpr(*[f"__row.{quoted(c)} AS {quoted(c)}" for c in keep], *results)
