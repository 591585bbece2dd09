"""Exact order statistics of columns of any size, by one method whatever the size.

Wanted ranks lie in brackets of values with open ends. An approximate-quantile sketch proposes two
cut values for each bracket; one exact count then tells how many rows lie below, at, between, at and
above them. So each rank is settled at a cut value or moves to a smaller bracket, and a value that
most rows share is settled by its count alone. Brackets of few rows are counted per value. All
columns share the passes: a sketch or a count is one more column of an aggregate, nothing is
stacked or shuffled but the rows of the last small brackets. Many columns are counted in a few
aggregates of ``BATCH`` columns, since Spark generates no code for wider ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_POLICY, ScalePolicy

GRID = 2048
BATCH = 20  # columns of one aggregate of counts: four counts each stay below the 100 fields of generated code
PICK_ROWS = 2_000_000  # of all brackets that are counted per value, at most
BRACKET_ROWS = 50_000  # of one such bracket, at most: its running total is one task
LEAST_ROWS = 1_000  # so few rows of a bracket are always counted per value


def quantiles(df: DataFrame, columns, probs, policy: ScalePolicy = DEFAULT_POLICY) -> dict:
    """``{column: {prob: value}}`` with linear interpolation; nulls skipped, None if empty."""
    columns, probs = list(columns), list(probs)
    if not columns:
        return {}
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    row = df.agg(*[F.count(v).alias(f"n{n}") for n, v in enumerate(values)]).first()
    counts = [row[f"n{n}"] for n in range(len(columns))]
    ranks = []
    for n in counts:
        spots = [p * (n - 1) for p in probs] if n else []
        ranks.append(sorted({f(s) for s in spots for f in (math.floor, math.ceil)}))
    found = column_ranks(df, values, ranks, counts, policy)
    out = {}
    for number, c in enumerate(columns):
        out[c] = {}
        for p in probs:
            if not counts[number]:
                out[c][p] = None
                continue
            spot = p * (counts[number] - 1)
            low, high = found[number][math.floor(spot)], found[number][math.ceil(spot)]
            # equal ends need no interpolation, which infinite ones would not survive
            out[c][p] = low if low == high else low + (high - low) * (spot - math.floor(spot))
    return out


@dataclass(frozen=True)
class Bracket:
    """Values strictly between ``lo`` and ``hi`` (None: no end) of a column: ``rows`` rows after ``below`` smaller ones."""

    column: int
    lo: object
    hi: object
    below: int
    rows: int

    def holds(self, v: Column) -> Column:
        inside = v.isNotNull()
        if self.lo is not None:
            inside = inside & (v > F.lit(self.lo))
        if self.hi is not None:
            inside = inside & (v < F.lit(self.hi))
        return inside


def column_ranks(df: DataFrame, values, ranks, counts, policy: ScalePolicy = DEFAULT_POLICY) -> list:
    """Per column ``{rank: value}`` for 0-based ranks among its non-null values.

    ``values`` are columns of one type; there may be several over the same data, e.g. one per group.
    """
    done, open_ = [{} for _ in values], {}
    for c, (wanted, n) in enumerate(zip(ranks, counts)):
        if any(not 0 <= r < n for r in wanted):
            raise ValueError(f"ranks {wanted} outside {n} rows")
        if wanted:
            open_[Bracket(c, None, None, 0, n)] = list(wanted)
    while open_:
        limit = max(LEAST_ROWS, min(BRACKET_ROWS, min(PICK_ROWS, policy.exact_sort_rows) // len(open_)))
        small = {b: r for b, r in open_.items() if b.rows <= limit}
        large = {b: r for b, r in open_.items() if b.rows > limit}
        if small:
            for (c, rank), v in _pick(df, values, small).items():
                done[c][rank] = v
        open_ = _narrow(df, values, large, done) if large else {}
    return done


def in_batches(df: DataFrame, aggs) -> list:
    """The values of one-row aggregates, ``aggs`` being a list of them per column of ``df``; ``BATCH`` columns at a time."""
    out = []
    for start in range(0, len(aggs), BATCH):
        some = aggs[start : start + BATCH]
        row = iter(df.agg(*[a.alias(f"a{n}") for n, a in enumerate(a for group in some for a in group)]).first())
        out += [tuple(next(row) for _ in group) for group in some]
    return out


def _sketch(inside: Column, probs, doubles: bool) -> Column:
    """Approximate quantiles of a column. NaN, the largest double, has no place in a sketch of doubles: it stands for none."""
    if not doubles:
        return F.percentile_approx(inside, probs, 4 * GRID)
    made = F.kll_sketch_agg_double(F.when(~F.isnan(inside), inside), F.lit(4 * GRID))
    asked = F.array(*[F.lit(p) for p in probs])
    nothing = F.array(*[F.lit(math.nan) for _ in probs])
    return F.when(F.kll_sketch_get_n_double(made) > 0, F.kll_sketch_get_quantile_double(made, asked)).otherwise(nothing)


def _narrow(df, values, open_, done) -> dict:
    """Smaller brackets for the ranks of ``open_``; those that hit a cut value are put in ``done``."""
    old = list(open_)
    steps = {}  # (number of the old bracket, rank) -> the two steps of the grid around the rank
    for n, b in enumerate(old):
        for rank in open_[b]:
            # the two ranks around a median share their steps, and so their counts
            first, last = (rank - (rank - 1 in open_[b]), rank + (rank + 1 in open_[b]))
            low, high = ((r - b.below) / b.rows * GRID for r in (first, last))
            steps[n, rank] = max(0, math.floor(low) - 1), min(GRID, math.ceil(high) + 1)
    # a sketch is asked for these steps only: each costs a search through it
    asked = [sorted({j for rank in open_[b] for j in steps[n, rank]}) for n, b in enumerate(old)]
    doubles = isinstance(df.select(values[old[0].column]).schema[0].dataType, T.DoubleType)
    sketch = df.agg(
        *[
            _sketch(F.when(b.holds(values[b.column]), values[b.column]), [j / GRID for j in asked[n]], doubles).alias(f"q{n}")
            for n, b in enumerate(old)
        ]
    ).first()
    proposed = {}  # (number of the old bracket, lo, hi) -> ranks
    for (n, rank), ends in steps.items():
        proposed.setdefault((n, *(sketch[n][asked[n].index(j)] for j in ends)), []).append(rank)
    aggs = []
    for n, lo, hi in proposed:
        v = values[old[n].column]
        aggs.append([F.count_if(x) for x in (v < F.lit(lo), v <= F.lit(lo), v < F.lit(hi), v <= F.lit(hi))])
    out = {}
    for ((n, lo, hi), ranks), counts in zip(proposed.items(), in_batches(df, aggs)):
        b = old[n]
        # of all rows, so that a count is compared with the rank itself
        under_lo, upto_lo, under_hi, upto_hi = counts
        for rank in ranks:
            if rank < under_lo:
                new = Bracket(b.column, b.lo, lo, b.below, under_lo - b.below)
            elif rank < upto_lo:
                done[b.column][rank] = lo
                continue
            elif rank < under_hi:
                new = Bracket(b.column, lo, hi, upto_lo, under_hi - upto_lo)
            elif rank < upto_hi:
                done[b.column][rank] = hi
                continue
            else:
                new = Bracket(b.column, hi, b.hi, upto_hi, b.below + b.rows - upto_hi)
            out.setdefault(new, []).append(rank)
    return out


def _pick(df, values, open_) -> dict:
    """Read the wanted ranks off the counts per distinct value of brackets of few rows."""
    brackets = list(open_)
    inside = F.array(
        *[
            F.when(b.holds(values[b.column]), F.struct(F.lit(n).alias("b"), values[b.column].alias("v")))
            for n, b in enumerate(brackets)
        ]
    )
    rows = df.select(F.inline(F.array_compact(inside)))
    per_value = rows.groupBy("b", "v").agg(F.count("*").alias("n"))
    # a bracket here has few rows, so its running total is a small task
    upto = F.sum("n").over(Window.partitionBy("b").orderBy("v"))
    offsets = [(n, rank - b.below) for n, b in enumerate(brackets) for rank in open_[b]]
    wanted = F.broadcast(df.sparkSession.createDataFrame(offsets, "wb int, offset long"))  # the asked-for ranks
    hits = per_value.withColumn("upto", upto).join(wanted, F.expr("b = wb AND offset < upto AND offset >= upto - n"))
    return {
        (brackets[r["b"]].column, brackets[r["b"]].below + r["offset"]): r["v"]
        for r in hits.select("b", "offset", "v").collect()
    }


@dataclass(frozen=True)
class Cut:
    """The row at a rank: its sort values as far as needed, and how many of the ``tied`` rows with them to take."""

    values: tuple
    take: int
    tied: int


def lexicographic_cuts(df: DataFrame, group: str, keys, wanted: dict, counts: dict, policy=DEFAULT_POLICY) -> dict:
    """``{g: Cut}`` for the row at a 0-based rank of each group in the order of ``keys``.

    Keys hold no nulls. A later key is only looked at where the earlier ones leave a tie.
    """
    at = {g: ((), k, counts[g]) for g, k in wanted.items()}
    for j, key in enumerate(keys):
        open_ = [g for g, (_, _, n) in at.items() if n > 1 or j == 0]
        if not open_:
            break
        values = []
        for g in open_:
            here = F.col(group).eqNullSafe(F.lit(g))
            for name, v in zip(keys, at[g][0]):
                here = here & (F.col(name) == F.lit(v))
            values.append(F.when(here, F.col(key)))
        found = column_ranks(df, values, [[at[g][1]] for g in open_], [at[g][2] for g in open_], policy)
        cuts = [f[at[g][1]] for g, f in zip(open_, found)]
        aggs = []
        for n, (v, cut) in enumerate(zip(values, cuts)):
            aggs += [F.count_if(v < F.lit(cut)).alias(f"l{n}"), F.count_if(v == F.lit(cut)).alias(f"e{n}")]
        row = df.agg(*aggs).first()
        for n, (g, cut) in enumerate(zip(open_, cuts)):
            before, k, _ = at[g]
            at[g] = ((*before, cut), k - row[f"l{n}"], row[f"e{n}"])
    return {g: Cut(values, k + 1, n) for g, (values, k, n) in at.items()}
