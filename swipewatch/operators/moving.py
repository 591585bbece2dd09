"""Rolling aggregates over ``[t - w, t)`` that can be merged but not subtracted: extremes, ends, central moments.

Time is cut into blocks of length ``w``. A window reaches into two of them: it is what entered the row's own block
before ``t``, and what is left of the block before from ``t - w`` on. Each row is one *enter* event in its own block and
one *leave* event, ``w`` later, in the next. In a block in time order the entered rows are a growing frame; against time
order the rows not yet left are one. Both are aggregated in one step per event, and the two results are merged. Nothing is
ever subtracted: a deviation of 1 around a mean of 10**9 keeps its digits, and an extreme needs no memory of what is gone.

All windows and columns share one exchange on the key. Hot keys are cut into ordered chunks (``plans.chunks``): then a
block may lie in several chunks, and what its other chunks hold comes from totals per chunk of such blocks only, of which
there are at most about two for each chunk and window. What leaves after a hot key's last row, a long window's whole content,
is a chunk of its own: its rows see no more of it than its totals, so that no task holds it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_POLICY, ScalePolicy
from ..functions.scalars import window_label, window_micros
from ..plans.chunks import LONG_MAX, LONG_MIN, ChunkPlan, plan_chunks
from .rolling import quoted

_VALID = "(__k IS NOT NULL AND __t IS NOT NULL)"
_MOMENTS = {"mean": 1, "var": 2, "std": 2, "skew": 3, "kurt": 4}
AGGREGATES = ("min", "max", "first", "last", *_MOMENTS)
TASK_EVENTS = 200_000  # every window sorts the events of a task, so that many are dealt to one


@dataclass(frozen=True)
class Moving:
    """A double column to aggregate: ``outputs`` maps an aggregate to a name prefix. Nulls are skipped."""

    column: str
    outputs: dict  # e.g. {"min": "user_amount_min", "std": "user_amount_std"}

    @property
    def degree(self) -> int:
        return max((_MOMENTS.get(a, 0) for a in self.outputs), default=0)

    @property
    def kinds(self) -> set:
        return set(self.outputs) & {"min", "max", "first", "last"}


def moving(
    df: DataFrame,
    key: str,
    t: str,
    i: str,
    windows,
    columns,
    plan: ChunkPlan | None = None,
    source: DataFrame | None = None,
    policy: ScalePolicy = DEFAULT_POLICY,
    last: int | None = None,
    keep=None,
) -> DataFrame:
    """``df`` with one column per window and output of ``columns`` (:class:`Moving`); arguments as those of ``rolling.roll``.

    ``var`` and ``std`` are those of a sample; ``skew`` and ``kurt`` (excess) are corrected for bias. ``first`` and
    ``last`` are the values at the ends of the window in (t, i) order. All are null where they are not defined.
    """
    windows = sorted([(window_label(w), window_micros(w)) for w in windows], key=lambda w: w[1])
    for c in columns:
        if unknown := set(c.outputs) - set(AGGREGATES):
            raise ValueError(f"unknown moving aggregates {sorted(unknown)}; use {AGGREGATES}")
    source, keep = df if source is None else source, list(keep or df.columns)
    plan = plan_chunks(source, key, t, i, policy) if plan is None else plan
    if not plan.empty:
        plan = _closed(plan, source, key, t)
    events = plan.attach(_events(df, key, t, i, windows, columns, last, keep), "__k", "__t", "__i", where=_VALID)
    if not plan.empty:
        events = events.join(F.broadcast(_tails(plan)), F.expr("__k = __ek"), "left")
        events = events.where("__kind = 0 OR __end IS NULL OR __chunk < __end").drop("__ek", "__end")
    # windows are told by blocks of the key; one exchange serves all of them. The number of tasks goes by that
    # of events: a fixed number, or one by the bytes of the exchange, lets the sorts of a task grow with the input
    tasks = max(2, -(-plan.total * (1 + len(windows)) // TASK_EVENTS))
    events = events.repartition(tasks, "__k", "__chunk")
    hot = None if plan.empty else _events(source, key, t, i, windows, columns, last, None)
    for n, (_, length) in enumerate(windows, start=1):
        events = _one_window(events, n, length, columns, plan, hot)
    out = [f"__row.{quoted(c)} AS {quoted(c)}" for c in keep]
    for n, (label, _) in enumerate(windows, start=1):
        for k, c in enumerate(columns):
            for agg, prefix in c.outputs.items():
                out.append(f"IF({_VALID}, __{agg}{k}_{n}, NULL) AS {quoted(f'{prefix}_{label}')}")
    return events.selectExpr(*out)


def _closed(plan: ChunkPlan, source: DataFrame, key: str, t: str) -> ChunkPlan:
    """``plan`` with a cut after the last row of each hot key; one number for each of them comes back."""
    rows = plan.only_hot(source.selectExpr(f"{quoted(key)} AS __k", f"{quoted(t)} AS __t"), "__k")
    last = {r["__hot"]: r["last"] for r in rows.groupBy("__hot").agg(F.max("__t").alias("last")).collect()}
    return replace(plan, points={k: sorted({*points, (last[k] + 1, LONG_MIN)}) for k, points in plan.points.items()})


def _tails(plan: ChunkPlan) -> DataFrame:
    """The chunk after the last row of each hot key of a closed plan."""
    schema = T.StructType([T.StructField("__ek", plan.key_type), T.StructField("__end", T.IntegerType())])
    return plan.spark.createDataFrame([(k, len(points)) for k, points in plan.points.items()], schema)


def _events(df, key, t, i, windows, columns, last, keep) -> DataFrame:
    """Enter events (kind 0, with the row) and leave events (kind n for the n-th window)."""
    t, key, i = quoted(t), quoted(key), quoted(i)
    kinds = ", ".join(f"struct({n} AS kind, {w}L AS shift)" for n, w in [(0, 0), *enumerate([w for _, w in windows], 1)])
    # windows go by length, so the events up to the last instant come first
    in_time = " + ".join(f"IF({t} + {w}L <= {last}L, 1, 0)" for _, w in windows) if last is not None else str(len(windows))
    many = f"IF({key} IS NOT NULL AND {t} IS NOT NULL, 1 + {in_time or 0}, 1)"
    first = [f"{key} AS __k", f"{t} AS __t0", f"{i} AS __i0", f"explode(slice(array({kinds}), 1, {many})) AS __e"]
    second = ["__k", "__e.kind AS __kind", "__t0 + __e.shift AS __t", "__t0", "__i0"]
    # a leave event belongs to the last chunk of its instant
    second.append(f"IF(__e.kind = 0, __i0, {LONG_MAX - 1}L) AS __i")
    for k, c in enumerate(columns):
        first.append(f"cast({quoted(c.column)} AS double) AS __x{k}")
        second.append(f"IF(isnan(__x{k}), NULL, __x{k}) AS __x{k}")
    if keep is not None:
        first.append("struct(" + ", ".join(quoted(c) for c in keep) + ") AS __row0")
        second.append("IF(__e.kind = 0, __row0, NULL) AS __row")
    return df.selectExpr(*first).selectExpr(*second)


def _fields(c: Moving) -> list:
    """What a part of a window is summed up in."""
    return [*sorted(c.kinds), *(["n", "o", "m", "m2", "m3", "m4"][: c.degree + 2] if c.degree else [])]


def _raw(c: Moving, k: int, kind: int, over: str, origin: str) -> dict:
    """SQL of the fields over events of one kind, ``over`` a window or nothing; higher moments still as ratios."""
    x = f"IF(__kind = {kind}, __x{k}, NULL)"
    place = f"IF(__kind = {kind} AND __x{k} IS NOT NULL, struct(__t0, __i0, __x{k} AS x), NULL)"
    plain = {
        "min": f"min({x}) {over}",
        "max": f"max({x}) {over}",
        "first": f"min({place}) {over}",
        "last": f"max({place}) {over}",
        "n": f"cast(count({x}) {over} AS double)",
        "o": origin,
        "m": f"coalesce(avg({x} - {origin}) {over}, 0D)",
        "m2": f"coalesce(var_pop({x} - {origin}) {over}, 0D)",
        "m3": f"skewness({x} - {origin}) {over}",
        "m4": f"kurtosis({x} - {origin}) {over}",
    }
    return {f: plain[f] for f in _fields(c)}


def _sums(c: Moving, at: str) -> dict:
    """Sums of powers of deviations from the ratios of :func:`_raw` in the columns ``at`` + field."""
    n, v = f"{at}n", f"{at}m2"
    found = {"m2": f"{v} * {n}", "m3": f"IF({v} > 0, {at}m3 * {v} * sqrt({v}) * {n}, 0D)"}
    found["m4"] = f"IF({v} > 0, ({at}m4 + 3) * {v} * {v} * {n}, 0D)"
    return {f: found.get(f, f"{at}{f}") for f in _fields(c)}


def _merged(c: Moving, a: str, b: str) -> dict:
    """The fields of two parts put together; ``a`` and ``b`` are prefixes of columns, null fields stand for no rows."""
    x = {f: f"{a}{f}" for f in _fields(c)}
    y = {f: f"{b}{f}" for f in _fields(c)}
    out = {"min": "least", "max": "greatest", "first": "least", "last": "greatest"}
    out = {f: f"{g}({x[f]}, {y[f]})" for f, g in out.items() if f in c.kinds}
    if not c.degree:
        return out
    p, q = f"coalesce({x['n']}, 0D)", f"coalesce({y['n']}, 0D)"
    both, d = f"({p} + {q})", f"({y['o']} - {x['o']} + {y['m']} - {x['m']})"
    share = f"({p} * {q} / {both})"
    new = {
        "m": f"{x['m']} + {d} * {q} / {both}",
        "m2": f"{x.get('m2')} + {y.get('m2')} + {d} * {d} * {share}",
        "m3": f"{x.get('m3')} + {y.get('m3')} + {d} * {d} * {d} * {share} * ({p} - {q}) / {both}"
        f" + 3 * {d} * ({p} * {y.get('m2')} - {q} * {x.get('m2')}) / {both}",
        "m4": f"{x.get('m4')} + {y.get('m4')}"
        f" + {d} * {d} * {d} * {d} * {share} * ({p} * {p} - {p} * {q} + {q} * {q}) / ({both} * {both})"
        f" + 6 * {d} * {d} * ({p} * {p} * {y.get('m2')} + {q} * {q} * {x.get('m2')}) / ({both} * {both})"
        f" + 4 * {d} * ({p} * {y.get('m3')} - {q} * {x.get('m3')}) / {both}",
    }
    out["n"] = both
    # a part without rows gives way to the other
    out["o"] = f"IF({p} > 0, {x['o']}, {y['o']})"
    for f in _fields(c):
        if f in new:
            out[f] = f"CASE WHEN {q} = 0 THEN {x[f]} WHEN {p} = 0 THEN {y[f]} ELSE {new[f]} END"
    return out


def _result(agg: str, at: str) -> str:
    n, m2 = f"{at}n", f"{at}m2"
    return {
        "min": f"{at}min",
        "max": f"{at}max",
        "first": f"{at}first.x",
        "last": f"{at}last.x",
        "mean": f"IF({n} > 0, {at}o + {at}m, NULL)",
        "var": f"IF({n} > 1, {m2} / ({n} - 1), NULL)",
        "std": f"IF({n} > 1, sqrt({m2} / ({n} - 1)), NULL)",
        "skew": f"IF({n} > 2 AND {m2} > 0, {at}m3 * {n} * sqrt({n} - 1) / ({n} - 2) / ({m2} * sqrt({m2})), NULL)",
        "kurt": f"IF({n} > 3 AND {m2} > 0, ({n} - 1) / ({n} - 2) / ({n} - 3) *"
        f" (({n} + 1) * {n} * {at}m4 / ({m2} * {m2}) - 3 * ({n} - 1)), NULL)",
    }[agg]


def _with(df: DataFrame, made: dict, drop=()) -> DataFrame:
    kept = [c for c in df.columns if c not in drop and c not in made]
    return df.selectExpr(*kept, *[f"{x} AS {name}" for name, x in made.items()])


def _block(length: int) -> str:
    return f"((__t - pmod(__t, {length}L)) div {length}L)"


def _one_window(events: DataFrame, n: int, length: int, columns, plan: ChunkPlan, hot: DataFrame | None) -> DataFrame:
    """Adds the results of the n-th window to the enter events; its leave events go."""
    rows = _with(events, {"__b": _block(length)})
    group = "PARTITION BY __k, __chunk, __b"
    before = f"OVER ({group} ORDER BY __t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    not_left = f"OVER ({group} ORDER BY __t DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    # deviations are taken from a value of the block itself; in the order of ``before``, which saves a sort
    whole = f"OVER ({group} ORDER BY __t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    rows = _with(rows, {f"__o{k}": f"coalesce(min(__x{k}) {whole}, 0D)" for k, c in enumerate(columns) if c.degree})
    parts = {}
    for k, c in enumerate(columns):
        parts |= {f"__p{k}{f}": x for f, x in _raw(c, k, 0, before, f"__o{k}").items()}
        parts |= {f"__s{k}{f}": x for f, x in _raw(c, k, n, not_left, f"__o{k}").items()}
    rows = _with(rows, parts).filter(f"__kind = 0 OR __kind > {n}")
    rows = _with(rows, {f"__{s}{k}{f}": x for k, c in enumerate(columns) for s in "ps" for f, x in _sums(c, f"__{s}{k}").items()})
    spare = {"__b"} | {f"__o{k}" for k in range(len(columns))}
    if hot is not None:
        carry = _carry(hot, n, length, columns, plan)
        spare |= set(carry.columns)
        rows = rows.join(F.broadcast(carry), F.expr("__k = __ck AND __chunk = __cc AND __b = __cb"), "left")
        for s, order in (("p", "{c} {own}"), ("s", "{own} {c}")):
            made = {}
            for k, c in enumerate(columns):
                a, b = order.format(c=f"__{s}c{k}", own=f"__{s}{k}").split()
                made |= {f"__{s}{k}{f}": x for f, x in _merged(c, a, b).items()}
            rows = _with(rows, made)
    # the older part first
    whole = {f"__w{k}{f}": x for k, c in enumerate(columns) for f, x in _merged(c, f"__s{k}", f"__p{k}").items()}
    spare |= set(parts)
    rows = _with(rows, whole, spare)
    results = {f"__{agg}{k}_{n}": _result(agg, f"__w{k}") for k, c in enumerate(columns) for agg in c.outputs}
    return _with(rows, results, set(whole))


def _carry(hot: DataFrame, n: int, length: int, columns, plan: ChunkPlan) -> DataFrame:
    """What the other chunks of a block hold: entered in chunks before (columns ``__pc``), not left in chunks after (``__sc``).

    Only blocks with a cut point in them lie in several chunks.
    """
    cut = sorted({(k, t // length) for k, points in plan.points.items() for t, _ in points}, key=str)
    schema = T.StructType([T.StructField("__bk", plan.key_type), T.StructField("__bb", T.LongType())])
    several = F.broadcast(plan.spark.createDataFrame(cut, schema))
    located = plan.located(plan.only_hot(hot.filter(f"__kind IN (0, {n})"), "__k"), "__t", "__i")
    located = _with(located, {"__b": _block(length)}).join(several, F.expr("__hot = __bk AND __b = __bb"))
    # deviations are taken from one value of the block in all its chunks
    if origins := [F.expr(f"coalesce(min(__x{k}), 0D)").alias(f"__o{k}") for k, c in enumerate(columns) if c.degree]:
        per_block = located.groupBy(F.col("__hot").alias("__ok"), F.col("__b").alias("__ob")).agg(*origins)
        located = located.join(F.broadcast(per_block), F.expr("__hot = __ok AND __b = __ob"))
    raw = []
    for k, c in enumerate(columns):
        for s, kind in (("p", 0), ("s", n)):
            found = _raw(c, k, kind, "", f"__o{k}")
            raw += [F.expr(x if f != "o" else f"min(__o{k})").alias(f"__{s}{k}{f}") for f, x in found.items()]
    totals = located.groupBy("__hot", "__chunk", "__b").agg(*raw)
    totals = _with(totals, {f"__{s}{k}{f}": x for k, c in enumerate(columns) for s in "ps" for f, x in _sums(c, f"__{s}{k}").items()})
    totals = totals.join(F.broadcast(plan.gates()), ["__hot", "__chunk"])
    group = "PARTITION BY __hot, __b"
    over = {
        "p": f"OVER ({group} ORDER BY __gate RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
        "s": f"OVER ({group} ORDER BY __chunk DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    }
    made, moments = {}, {}
    for k, c in enumerate(columns):
        for s, w in over.items():
            a, to = f"__{s}{k}", f"__{s}c{k}"
            for f in c.kinds:
                made[f"{to}{f}"] = f"{'min' if f in ('min', 'first') else 'max'}({a}{f}) {w}"
            if c.degree:
                made |= {f"{to}o": f"{a}o", f"{to}n": f"coalesce(sum({a}n) {w}, 0D)"}
                moments[k, s] = (a, to, f"{a}m", w, c.degree)
    totals = _with(totals, made)
    powers = {}
    for (k, s), (a, to, d, w, degree) in moments.items():
        n_, m2, m3, m4 = (f"{a}{f}" for f in ("n", "m2", "m3", "m4"))
        terms = [
            f"{n_} * {d}",
            f"{m2} + {n_} * {d} * {d}",
            f"{m3} + 3 * {d} * {m2} + {n_} * {d} * {d} * {d}",
            f"{m4} + 4 * {d} * {m3} + 6 * {d} * {d} * {m2} + {n_} * {d} * {d} * {d} * {d}",
        ]
        powers |= {f"__{s}q{k}_{j}": f"coalesce(sum({x}) {w}, 0D)" for j, x in enumerate(terms[:degree], 1)}
    totals = _with(totals, powers)
    central = {}
    for (k, s), (_, to, _, _, degree) in moments.items():
        q = {j: f"__{s}q{k}_{j}" for j in range(1, 5)}
        n_, m = f"{to}n", f"coalesce(try_divide({q[1]}, {to}n), 0D)"
        found = [
            m,
            f"greatest({q[2]} - {n_} * {m} * {m}, 0D)",
            f"{q[3]} - 3 * {m} * {q[2]} + 2 * {n_} * {m} * {m} * {m}",
            f"{q[4]} - 4 * {m} * {q[3]} + 6 * {m} * {m} * {q[2]} - 3 * {n_} * {m} * {m} * {m} * {m}",
        ]
        central |= {f"{to}{f}": x for f, x in zip(("m", "m2", "m3", "m4"), found[:degree])}
    totals = _with(totals, central)
    fields = [f"__{s}c{k}{f}" for k, c in enumerate(columns) for s in "ps" for f in _fields(c)]
    return totals.selectExpr("__hot AS __ck", "__chunk AS __cc", "__b AS __cb", *fields)
