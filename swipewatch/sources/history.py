"""Stored history of transactions, from which new rows get their features without the rows they look back to.

Two kinds of tables lie under one folder, cut by day: the rows themselves, narrow, and sums per key and day. What a
key had before an instant is then the sum of its whole days before, plus what its rows of that one day add; a window is the
difference of two such sums. A row with four windows reads single rows of five days, not of thirty, and no key's
rows are ever gathered: both parts are running totals (``plans.chunks``), so a hot key is cut into ranges here as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_POLICY, ScalePolicy, TxnConfig
from ..functions.scalars import window_label, window_micros
from ..operators.features import feature_names, prepare, summarize_users
from ..operators.rolling import History, quoted, roll
from ..plans.chunks import LONG_MIN, ordered_sums, plan_chunks
from .paths import folders, fresh_path

DAY = 86_400_000_000
FAMILIES = ("user", "merchant", "currency", "status")
_SUMS = ("r", "n", "s", "ln", "ls")  # rows, amounts, their cents, labels, positive labels


def _day(t: str) -> str:
    return f"(({t} - pmod({t}, {DAY}L)) div {DAY}L)"


class StoredHistory:
    """Rows and day sums under ``path``. A repeated :meth:`append` of one batch name replaces what it wrote before."""

    def __init__(self, spark: SparkSession, path: str, cfg: TxnConfig = TxnConfig()):
        self.spark, self.path, self.cfg = spark, path.rstrip("/"), cfg

    def append(self, df: DataFrame, batch: str = "0") -> None:
        """Adds transactions. Rows without a time are in no window and are not kept."""
        narrow = self.narrow(df)
        self._write(narrow, "rows", batch)
        # sums are made of what was stored
        kept = self._read("rows", None)
        if kept is None:
            return
        kept = kept.where(F.col("batch") == batch).drop("batch")
        for family in FAMILIES:
            if family in kept.columns:
                self._write(day_sums(kept, family), f"days_{family}", batch)
        if "user" in kept.columns:
            self._write(_day_moments(kept), "moments", batch)

    def narrow(self, df: DataFrame) -> DataFrame:
        """(t, i, day, amount, cents, label, and the key of each family that is there) of rows with a time."""
        keys = [F.col(getattr(self.cfg, f)).alias(f) for f in FAMILIES if getattr(self.cfg, f) in df.columns]
        base = prepare(df, self.cfg).select(
            F.col("__time_us").alias("t"), F.col("__tie").alias("i"), F.col("__amount").alias("amount"),
            F.col("__cents").alias("cents"), F.col("__label").alias("label"), *keys,
        )
        return base.where("t IS NOT NULL").withColumn("day", F.expr(_day("t")))

    def _write(self, df: DataFrame, table: str, batch: str) -> None:
        df.withColumn("batch", F.lit(batch)).hint("rebalance", "day").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("day", "batch").parquet(f"{self.path}/{table}")

    def _read(self, table: str, days: list | None) -> DataFrame | None:
        """A table, only the folders of ``days`` if given; None if there is nothing."""
        root = f"{self.path}/{table}"
        there = {d for d in folders(self.spark, root) if d.startswith("day=")}
        paths = [root] if days is None else [f"{root}/day={d}" for d in days if f"day={d}" in there]
        if not there or not paths:
            return None
        read = self.spark.read.option("basePath", root).parquet(*paths)
        return read.withColumn("day", F.col("day").cast("long"))

    def rows(self, days: list | None = None) -> DataFrame | None:
        found = self._read("rows", days)
        return None if found is None else found.drop("batch")

    def days(self, family: str) -> DataFrame | None:
        found = self._read(f"days_{family}", None)
        return None if found is None else found.drop("batch")

    def moments(self) -> DataFrame | None:
        found = self._read("moments", None)
        return None if found is None else found.drop("batch")


def _measured(rows: DataFrame, family: str) -> DataFrame:
    return rows.where(f"{family} IS NOT NULL").selectExpr(
        f"{family} AS k", "day", "t", "i", "1L AS r", "IF(cents IS NULL, 0L, 1L) AS n", "coalesce(cents, 0L) AS s",
        "IF(label IS NULL, 0L, 1L) AS ln", "coalesce(label, 0L) AS ls",
    )


def day_sums(rows: DataFrame, family: str) -> DataFrame:
    """(k, day, sums) of narrow rows."""
    return _measured(rows, family).groupBy("k", "day").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _day_moments(rows: DataFrame) -> DataFrame:
    cfg = TxnConfig(id="i", time="at", user="user", amount="amount")
    timed = rows.select("user", "i", "day", "amount", F.timestamp_micros("t").alias("at"))
    return summarize_users(timed, cfg, ["day"])


def _union(a: DataFrame, b: DataFrame | None) -> DataFrame:
    return a if b is None else a.unionByName(b.select(*a.columns))


def _large(df: DataFrame) -> DataFrame:
    """Keys and instants go by the input. Many joins of such sides are in one plan here, each just small enough to be broadcast;
    together they would not fit the driver, so none is."""
    return df.hint("merge")


def _before(points: DataFrame, rows: DataFrame, days: DataFrame, policy: ScalePolicy) -> DataFrame:
    """(k, x, sums over all rows of the key before ``x``) for ``points`` (k, day, x)."""
    zeros = [f"0L AS {c}" for c in _SUMS]
    asked = points.select("k", "day", "x").distinct()
    own_days = asked.select("k", "day").distinct()
    # within the day of the point
    near = rows.join(_large(own_days), ["k", "day"], "left_semi").selectExpr("struct(k, day) AS g", "t", "i", *_SUMS, "false AS asks")
    both = near.unionByName(asked.selectExpr("struct(k, day) AS g", "x AS t", f"{LONG_MIN}L AS i", *zeros, "true AS asks"))
    inside = ordered_sums(both, "g", "t", "i", {f"in_{c}": c for c in _SUMS}, plan_chunks(both, "g", "t", "i", policy))
    inside = inside.where("asks").selectExpr("g.k AS k", "g.day AS day", "t AS x", *[f"in_{c}" for c in _SUMS])
    # whole days before it
    past = days.join(_large(asked.select("k").distinct()), "k", "left_semi").selectExpr("k", "day AS t", "0L AS i", *_SUMS, "false AS asks")
    both = past.unionByName(own_days.selectExpr("k", "day AS t", f"{LONG_MIN}L AS i", *zeros, "true AS asks"))
    whole = ordered_sums(both, "k", "t", "i", {f"day_{c}": c for c in _SUMS}, plan_chunks(both, "k", "t", "i", policy))
    whole = whole.where("asks").selectExpr("k", "t AS day", *[f"day_{c}" for c in _SUMS])
    return inside.join(_large(whole), ["k", "day"]).selectExpr("k", "x", *[f"in_{c} + day_{c} AS {c}" for c in _SUMS])


def _windows_of(new: DataFrame, family: str, stored: StoredHistory, cfg: TxnConfig, policy: ScalePolicy) -> DataFrame:
    """(k, t, one column per window feature of the family) for the keys and instants of the narrow rows ``new``."""
    windows = [(window_label(w), window_micros(w)) for w in cfg.windows]
    delay = window_micros(cfg.label_delay) if cfg.label_delay else 0
    shifts = sorted({0, delay, *[w for _, w in windows]})
    units = new.where(f"{family} IS NOT NULL").selectExpr(f"{family} AS k", "t").distinct()
    edges = ", ".join(f"struct({n} AS j, t - {s}L AS x)" for n, s in enumerate(shifts))
    points = units.selectExpr("k", "t", f"inline(array({edges}))").withColumn("day", F.expr(_day("x")))
    wanted = sorted(r["day"] for r in points.select("day").distinct().collect())  # days, not rows
    rows = _measured(_union(new, stored.rows(wanted)), family)
    days = _union(day_sums(new, family), stored.days(family))
    sums = points.join(_large(_before(points, rows, days, policy)), ["k", "x"])
    at = {s: n for n, s in enumerate(shifts)}
    wide = sums.groupBy("k", "t").agg(
        *[F.sum(F.when(F.col("j") == n, F.col(c))).alias(f"{c}{n}") for n in range(len(shifts)) for c in _SUMS]
    )
    made = ["k AS __k", "t AS __t"]
    for label, w in windows:
        r, n, s = (f"({c}{at[0]} - {c}{at[w]})" for c in ("r", "n", "s"))
        ln, ls = (f"({c}{at[delay]} - {c}{at[w]})" for c in ("ln", "ls"))
        made.append(f"IF({r} > 0, {n}, NULL) AS {family}_txn_count_{label}")
        made.append(f"IF({n} > 0, {s} / 100D, NULL) AS {family}_amount_sum_{label}")
        made.append(f"IF({n} > 0, {s} / {n} / 100D, NULL) AS {family}_amount_mean_{label}")
        seen = "false" if delay >= w else f"{ln} > 0"
        made.append(f"IF({seen}, {ls} / {ln}, NULL) AS {family}_fraud_rate_{label}")
    return wide.selectExpr(*made)


def _moments_before(days: DataFrame, asked: DataFrame) -> DataFrame:
    """Summary of all days before the one in ``k`` (key, day), for the pairs in ``asked``."""
    points = asked.selectExpr("user AS k", "day", "true AS asks").distinct()
    mine = days.join(_large(points.select("k").distinct()), "k", "left_semi").withColumn("asks", F.lit(False))
    both = mine.unionByName(points, allowMissingColumns=True)
    # rows are days of one user here: few, whatever the user's transactions
    past = "(PARTITION BY k ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    both = both.selectExpr("*", "first(mean, true) OVER (PARTITION BY k ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS o")
    both = both.selectExpr(
        "k", "day", "asks", "o", f"coalesce(sum(n) OVER {past}, 0D) AS n", f"sum(n * (mean - o)) OVER {past} AS s1",
        f"sum(m2 + n * (mean - o) * (mean - o)) OVER {past} AS s2", f"max(last_t) OVER {past} AS last_t",
        f"min(lo) OVER {past} AS lo", f"max(hi) OVER {past} AS hi",
    )
    return both.where("asks").selectExpr(
        "struct(k, day) AS k", "n", "o + try_divide(s1, n) AS mean", "greatest(coalesce(s2 - try_divide(s1 * s1, n), 0D), 0D) AS m2",
        "last_t", "lo", "hi",
    )


def features_from_history(
    df: DataFrame, stored: StoredHistory, cfg: TxnConfig | None = None, policy: ScalePolicy = DEFAULT_POLICY
) -> DataFrame:
    """The features of ``df`` as if it had been appended to the stored rows: same columns and values as ``add_features``.

    Rows of ``df`` see the stored rows and one another. They are not stored (see ``StoredHistory.append``) and must not be
    stored yet.
    """
    cfg = cfg or stored.cfg
    spark, columns = df.sparkSession, df.columns
    path = fresh_path(spark, "new_rows")
    df.write.parquet(path)
    df = spark.read.schema(df.schema).parquet(path)
    new = stored.narrow(df)
    out = prepare(df, cfg)
    if cfg.user in columns:
        days = _union(_day_moments(new), stored.moments())
        today = new.select("user", "day").distinct()
        frame = out.withColumn("__here", F.lit(True)).withColumn("__user_day", F.expr(f"struct({quoted(cfg.user)} AS k, {_day('__time_us')} AS day)"))
        frame = frame.withColumn("__user_day", F.expr(f"IF({quoted(cfg.user)} IS NULL OR __time_us IS NULL, NULL, __user_day)"))
        past = stored.rows(sorted(r["day"] for r in today.select("day").distinct().collect()))
        if past is not None:
            past = past.join(_large(today), ["user", "day"], "left_semi").selectExpr(
                "struct(user AS k, day) AS __user_day", "t AS __time_us", "i AS __tie", "amount AS __amount", "false AS __here"
            )
            frame = frame.unionByName(past, allowMissingColumns=True)
        history = History("__amount", "user_amount_zscore", "user_time_since_last_txn")
        older = _moments_before(days, today)
        keep = [*out.columns, "__here"]
        out = roll(frame, "__user_day", "__time_us", "__tie", (), [], history, policy=policy, older=older, keep=keep)
        out = out.where("__here").drop("__here")
    wanted = feature_names(columns, cfg)
    if cfg.windows:
        for family in FAMILIES:
            key = getattr(cfg, family)
            if key in columns:
                told = _windows_of(new, family, stored, cfg, policy)
                told = told.select("__k", "__t", *[c for c in told.columns if c in wanted])
                out = out.join(_large(told), F.expr(f"{quoted(key)} = __k AND __time_us = __t"), "left").drop("__k", "__t")
    return out.select(*columns, *wanted)
