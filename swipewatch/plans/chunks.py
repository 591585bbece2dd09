"""Ordered chunks: running totals over a key without putting the key into one task.

A window such as ``partitionBy(user).orderBy(time)`` sends every row of a user to the same
task. Most users are small, but one user (or currency, or the whole table) may hold a large
share of all rows. Here such hot keys are cut into consecutive ranges of ``(t, i)``, the
order value and a tie-breaker. Windows then run per ``(key, chunk)``, and what lies before a
chunk comes from a table of per-chunk totals.

Sizes: a key is hot above ``limit = policy.chunk_limit(total)`` rows, and gets about
``rows / limit`` chunks. So there are at most ``total / limit <= max_chunks`` hot keys and
at most twice as many chunks: both the cut points and the totals are small enough to collect
and broadcast whatever the input size. The cut points are literals in the plan, so a task
that is run again after an executor is lost assigns the same chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_POLICY, ScalePolicy

LONG_MIN = -(2**63)
LONG_MAX = 2**63 - 1
SPREAD = 4096  # buckets over which rows that take part in no window are spread


def tie_key(df: DataFrame, id_name: str | None) -> Column:
    """Whole-number tie-breaker: the id itself, or a hash where it is no integer."""
    if id_name and id_name in df.columns:
        if isinstance(df.schema[id_name].dataType, T.IntegralType):
            return F.col(id_name).cast("bigint")
        return F.xxhash64(id_name)
    return F.xxhash64(*df.columns)


@dataclass
class ChunkPlan:
    """Cut points of the hot keys; ``points[key]`` is a sorted list of ``(t, i)`` starts."""

    spark: SparkSession
    key_type: T.DataType
    t_type: T.DataType
    points: dict
    total: int

    @property
    def empty(self) -> bool:
        return not self.points

    @property
    def chunk_count(self) -> int:
        return sum(len(p) + 1 for p in self.points.values())

    def _points_frame(self) -> DataFrame:
        """One row per hot key; two flat arrays, because comparing numbers is cheaper than structs."""
        schema = T.StructType(
            [
                T.StructField("__hot", self.key_type),
                T.StructField("__pt", T.ArrayType(self.t_type)),
                T.StructField("__pi", T.ArrayType(T.LongType())),
            ]
        )
        rows = [(k, [t for t, _ in p], [i for _, i in p]) for k, p in self.points.items()]
        return self.spark.createDataFrame(rows, schema)

    def gates(self) -> DataFrame:
        """Every (key, chunk) with its gate: the first chunk that holds the same instant.

        Rows at one instant do not see each other in a time-range window, even when the
        instant itself had to be cut by id. Such a row sees what lies before the gate.
        """
        rows = []
        for key, points in self.points.items():
            rows.append((key, 0, 0))
            gate = 0
            for n, (t, i) in enumerate(points, start=1):
                inside_instant = i not in (LONG_MIN, LONG_MAX)
                gate = gate if inside_instant else n
                rows.append((key, n, gate))
        schema = T.StructType(
            [
                T.StructField("__hot", self.key_type),
                T.StructField("__chunk", T.IntegerType()),
                T.StructField("__gate", T.IntegerType()),
            ]
        )
        return self.spark.createDataFrame(rows, schema)

    def only_hot(self, df: DataFrame, key: str) -> DataFrame:
        """Rows of the hot keys with their cut points (bounded broadcast)."""
        return df.join(F.broadcast(self._points_frame()), F.col(key) == F.col("__hot"))

    def attach(self, df: DataFrame, key: str, t: str, i: str, where: str | None = None) -> DataFrame:
        """Add ``__chunk``; 0 for keys that are not hot.

        Rows that fail ``where`` take part in no window: they get negative numbers that
        spread them evenly over the tasks.
        """
        chunk = "0"
        if not self.empty:
            df = df.join(F.broadcast(self._points_frame()), F.col(key) == F.col("__hot"), "left")
            chunk = f"IF(__pt IS NULL, 0, {self._locate(t, i)})"
        if where:
            chunk = f"IF({where}, {chunk}, cast(-1 - pmod(xxhash64({i}), {SPREAD}) AS int))"
        return df.withColumn("__chunk", F.expr(chunk)).drop("__hot", "__pt", "__pi")

    def located(self, df: DataFrame, t: str, i: str) -> DataFrame:
        """Add ``__chunk`` to the rows of :meth:`only_hot`."""
        return df.withColumn("__chunk", F.expr(self._locate(t, i)))

    def _locate(self, t: str, i: str) -> str:
        """Number of cut points at or before ``(t, i)``, by bisection."""
        longest = max(len(p) for p in self.points.values())
        steps = ", ".join(str(1 << b) for b in reversed(range(longest.bit_length())))
        at = "pos + step - 1"
        before = f"get(__pt, {at}) < {t} OR (get(__pt, {at}) = {t} AND get(__pi, {at}) <= {i})"
        return f"aggregate(array({steps}), 0, (pos, step) -> IF({before}, pos + step, pos))"


def plan_chunks(
    df: DataFrame,
    key: str,
    t: str,
    i: str,
    policy: ScalePolicy = DEFAULT_POLICY,
    total: int | None = None,
) -> ChunkPlan:
    """Find the hot keys of ``df`` and where to cut them.

    ``df`` should be backed by a table: it is scanned once for the row counts per key, and
    again (columns ``key, t, i`` only) when there are hot keys. Tables that fit one group
    are not scanned at all.
    """
    return plan_chunks_for(df, [key], t, i, policy, total)[key]


def plan_chunks_for(
    df: DataFrame, keys, t: str, i: str, policy: ScalePolicy = DEFAULT_POLICY, total: int | None = None
) -> dict:
    """A plan per key column; the rows per value of all of them are counted in one pass."""
    total = df.count() if total is None else total
    limit = policy.chunk_limit(total)
    spark, t_type = df.sparkSession, df.schema[t].dataType
    plans = {k: ChunkPlan(spark, df.schema[k].dataType, t_type, {}, total) for k in keys}
    if total <= limit:
        return plans
    # at most total / limit values per key column come back
    timed = df.filter(F.col(t).isNotNull())
    counted = (
        timed.groupBy(*keys) if len(keys) == 1 else timed.groupingSets([[k] for k in keys], *keys)
    ).agg(F.count("*").alias("__n"), *([F.grouping_id().alias("__set")] if len(keys) > 1 else []))
    found = counted.filter(F.col("__n") > limit).collect()
    for position, k in enumerate(keys):
        # a column is grouped by where its bit of the grouping id is 0
        bit = 1 << (len(keys) - 1 - position)
        hot = {
            r[k]: r["__n"] for r in found if r[k] is not None and (len(keys) == 1 or not r["__set"] & bit)
        }
        if hot:
            plans[k].points.update(_cut_points(df, k, t, i, hot, limit))
    return plans


def _cut_points(df, key, t, i, hot, limit) -> dict:
    spark, key_type, t_type = df.sparkSession, df.schema[key].dataType, df.schema[t].dataType
    rows = df.filter(F.col(key).isNotNull() & F.col(t).isNotNull()).select(
        F.col(key).alias("k"), F.col(t).alias("t"), F.col(i).alias("i")
    )
    cuts = _cut_times(spark, rows, hot, key_type, limit)
    instants = {
        (k, v): times.count(v) + 1 for k, times in cuts.items() for v in set(times) if times.count(v) > 1
    }
    by_id = _cut_ids(spark, rows, instants, key_type, t_type) if instants else {}
    points = {}
    for k, times in cuts.items():
        found = set()
        for v in times:
            found.add((v, LONG_MIN))
            if (k, v) in instants:
                found.update((v, n) for n in by_id.get((k, v), ()))
                found.add((v, LONG_MAX))
        points[k] = sorted(found)
    return points


def _sketched(joined: DataFrame, keys, value: str, sizes) -> DataFrame:
    """Per key the ``parts - 1`` approximate quantiles ``q`` that cut ``value`` into ``parts`` pieces.

    ``size`` is the power of two that holds ``parts``; a key is sketched with the grid of its own
    size, so that a key of few parts does not carry the grid of the largest one.
    """
    aggs = []
    for size in sizes:
        probs = [j / (1 << size) for j in range(1, 1 << size)]
        mine = F.when(F.col("size") == size, F.col(value))
        aggs.append(F.percentile_approx(mine, probs, max(10_000, 10 << size)).alias(f"q{size}"))
    made = joined.groupBy(*keys, "parts", "size").agg(*aggs)
    made = made.withColumn("q", F.coalesce(*[F.col(f"q{size}") for size in sizes]))
    grid = F.expr("shiftleft(1, size)")
    # only these travel to the driver
    picked = F.transform(
        F.sequence(F.lit(1), F.col("parts") - 1),
        lambda j: F.get("q", F.greatest(F.floor(j * grid / F.col("parts")).cast("int") - 1, F.lit(0))),
    )
    return made.select(*keys, picked.alias("q"))


def _size(parts: int) -> int:
    return max(1, (parts - 1).bit_length())


def _cut_times(spark, rows, hot, key_type, limit) -> dict:
    """Approximate time quantiles of each hot key: as many as it needs chunks."""
    parts = {k: -(-n // limit) for k, n in hot.items()}
    wanted = spark.createDataFrame(
        [(k, n, _size(n)) for k, n in parts.items()],
        T.StructType(
            [
                T.StructField("hk", key_type),
                T.StructField("parts", T.IntegerType()),
                T.StructField("size", T.IntegerType()),
            ]
        ),
    )
    joined = rows.join(F.broadcast(wanted), F.col("k") == F.col("hk"))
    found = _sketched(joined, ["k"], "t", sorted({_size(n) for n in parts.values()}))
    return {r["k"]: sorted(r["q"]) for r in found.collect()}


def _cut_ids(spark, rows, instants, key_type, t_type) -> dict:
    """Cut overfull instants of a key by id."""
    wanted = spark.createDataFrame(
        [(k, v, n, _size(n)) for (k, v), n in instants.items()],
        T.StructType(
            [
                T.StructField("hk", key_type),
                T.StructField("ht", t_type),
                T.StructField("parts", T.IntegerType()),
                T.StructField("size", T.IntegerType()),
            ]
        ),
    )
    joined = rows.join(F.broadcast(wanted), (F.col("k") == F.col("hk")) & (F.col("t") == F.col("ht")))
    found = _sketched(joined, ["k", "t"], "i", sorted({_size(n) for n in instants.values()}))
    return {(r["k"], r["t"]): set(r["q"]) for r in found.collect()}


def ordered_sums(df: DataFrame, key: str, t: str, i: str, sums: dict, plan: ChunkPlan) -> DataFrame:
    """Add, per key, the sums over all rows strictly before the row in ``(t, i)`` order.

    ``sums`` maps a new column name to the SQL text of a whole-number value.
    """
    before = f"(PARTITION BY {key}, __chunk ORDER BY {t}, {i} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    out = plan.attach(df, key, t, i).selectExpr(
        "*", *[f"coalesce(sum({x}) OVER {before}, 0L) AS {name}" for name, x in sums.items()]
    )
    if plan.empty:
        return out
    totals = (
        plan.located(plan.only_hot(df, key), t, i)
        .groupBy("__hot", "__chunk")
        .agg(*[F.expr(f"sum({x})").alias(name) for name, x in sums.items()])
    )
    chunks_before = "(PARTITION BY __hot ORDER BY __chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carry = (
        plan.gates()
        .join(totals, ["__hot", "__chunk"], "left")
        .selectExpr(
            "__hot AS __ck",
            "__chunk AS __cc",
            *[f"coalesce(sum({name}) OVER {chunks_before}, 0L) AS {name}_c" for name in sums],
        )
    )
    joined = out.join(F.broadcast(carry), F.expr(f"{key} = __ck AND __chunk = __cc"), "left")
    kept = [c for c in out.columns if c not in sums]
    return joined.selectExpr(*[f"`{c}`" for c in kept], *[f"{n} + coalesce({n}_c, 0L) AS {n}" for n in sums])
