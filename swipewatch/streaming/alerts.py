"""Alerts on single users of a transaction stream: too many transactions at once, silence, return after silence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TxnConfig
from ..functions.scalars import micros, window_micros
from ..sources.paths import folders, remove


@dataclass(frozen=True)
class AlertPolicy:
    """``width`` of a window, most transactions in it, how long a user may be silent, and when a silent user is forgotten."""

    width: str = "1h"
    max_txns: int = 10
    silence: str = "7d"
    forget: str = "365d"
    late: str = "1h"


def _closed(t: str, width: int) -> str:
    """SQL text: the instant at which the window of ``t`` is closed."""
    return f"({t} - pmod({t}, {width}L) + {width}L)"


def user_windows(
    df: DataFrame, p: AlertPolicy = AlertPolicy(), cfg: TxnConfig = TxnConfig(), open_: DataFrame | None = None
) -> DataFrame:
    """Transactions per user and window with the first and last time in it; ``w`` is the window's start. Counted map-side
    first, so that a user with very many rows sends a few per task. Rows without user or time belong to no window.
    ``open_`` holds windows counted so far, which are counted on."""
    width, t = window_micros(p.width), micros(F.col(cfg.time))
    rows = df.where(F.col(cfg.user).isNotNull() & F.col(cfg.time).isNotNull()).select(
        F.col(cfg.user).alias("user_id"), t.alias("first"), t.alias("last"), F.lit(1).cast("long").alias("txns")
    )
    rows = rows.selectExpr("user_id", f"{_closed('first', width)} - {width}L AS w", "txns", "first", "last")
    if open_ is not None:
        rows = rows.unionByName(open_)
    return rows.groupBy("user_id", "w").agg(F.sum("txns").alias("txns"), F.min("first").alias("first"), F.max("last").alias("last"))


class AlertState:
    """What a stream of alerts knows, in tables below ``path``; each names its micro-batch, so that a batch that is
    repeated reads what the batch before left and overwrites its own.

    ``windows``   counted windows, closed ones apart from those that are still open
    ``users``     per user the newest time in closed windows and whether its silence was told
    ``progress``  the instant up to which windows are closed
    """

    def __init__(self, out_path: str, path: str, p: AlertPolicy, cfg: TxnConfig):
        self.out_path, self.path, self.p, self.cfg = out_path.rstrip("/"), path.rstrip("/"), p, cfg

    def _read(self, spark: SparkSession, table: str, before: int, schema: T.StructType | None = None) -> DataFrame | None:
        """What the batch before left; older batches' tables are removed."""
        root = f"{self.path}/{table}"
        numbers = sorted(n for d in folders(spark, root) if (n := int(d.split("=")[1])) < before)
        for n in numbers[:-1]:
            remove(spark, f"{root}/batch={n}")
        if not numbers:
            return None
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(f"{root}/batch={numbers[-1]}")

    def process(self, rows: DataFrame, batch: int) -> None:
        spark, p = rows.sparkSession, self.p
        width, late = window_micros(p.width), window_micros(p.late) // 1000
        progress = self._read(spark, "progress", batch)
        passed = progress.first()["mark"] if progress is not None else None
        newest = rows.agg(F.max(micros(F.col(self.cfg.time)))).first()[0]
        mark = passed
        if newest is not None:  # in whole milliseconds, as Spark counts watermarks
            mark = max((newest // 1000 - late) * 1000, passed if passed is not None else newest - 2**62)
        if mark is not None:
            self._close(rows, batch, passed, mark, width)
        spark.createDataFrame([(mark,)], "mark long").write.mode("overwrite").parquet(f"{self.path}/progress/batch={batch}")

    def _close(self, rows: DataFrame, batch: int, passed: int | None, mark: int, width: int) -> None:
        spark, here = rows.sparkSession, f"batch={batch}"
        silence, forget = window_micros(self.p.silence), window_micros(self.p.forget)
        if passed is not None:
            t = micros(F.col(self.cfg.time))
            rows = rows.where(t - F.pmod(t, F.lit(width)) + width > passed)
        counted = user_windows(rows, self.p, self.cfg)
        # given, for a folder of no rows tells no columns
        schema = T.StructType([*counted.schema.fields, T.StructField("is_open", T.IntegerType())])
        before = self._read(spark, "windows", batch, schema)
        if before is not None:
            counted = user_windows(rows, self.p, self.cfg, before.where("is_open = 1").drop("is_open"))
        # written once: closed windows are read for the alerts and for the users, open ones by the next batch
        counted.withColumn("is_open", F.expr(f"IF(w + {width}L > {mark}L, 1, 0)")).write.mode("overwrite").partitionBy(
            "is_open"
        ).parquet(f"{self.path}/windows/{here}")
        written = spark.read.schema(schema).parquet(f"{self.path}/windows/{here}")
        known = written.where("is_open = 0").selectExpr("user_id", "w", "txns", "first", "last", "false AS told")
        users = self._read(spark, "users", batch)
        if users is not None:  # the newest time of the windows of earlier batches
            known = known.unionByName(users.selectExpr("user_id", "CAST(NULL AS bigint) AS w", "NULL AS txns", "NULL AS first", "last", "told"))
        # by then a transaction may no longer be found in the window that holds the end of the allowed silence
        silent = f"{_closed(f'last + {silence}L', width)} <= {mark}L"
        now = known.groupBy("user_id").agg(F.max("last").alias("last"), F.max_by("told", "last").alias("told"))
        now = now.selectExpr("user_id", "last", f"told OR {silent} AS told")
        now = now.where(f"NOT (told AND {_closed(f'last + {forget}L', width)} <= {mark}L)")
        now.write.mode("overwrite").parquet(f"{self.path}/users/{here}")

        by_time = "(PARTITION BY user_id ORDER BY last)"
        gaps = known.selectExpr(
            "*", *[f"lag({c}) OVER {by_time} AS {c}_before" for c in ("last", "told")], f"lead(last) OVER {by_time} IS NULL AS is_last"
        )
        gap, alert = "first - last_before", "named_struct('kind', '{}', 'us', {}, 'value', {})".format
        cases = [
            (f"txns > {self.p.max_txns}", alert("busy", "w", "txns")),
            (f"{gap} > {silence}L AND NOT told_before", alert("silent", "last_before", "CAST(NULL AS bigint)")),
            (f"{gap} > {silence}L AND {gap} <= {forget}L", alert("returned", "first", f"({gap}) div 1000000")),
            (f"is_last AND NOT told AND {silent}", alert("silent", "last", "CAST(NULL AS bigint)")),
        ]
        listed = ", ".join(f"IF({case}, {made}, NULL)" for case, made in cases)
        found = gaps.selectExpr("user_id", f"inline(array_compact(array({listed})))")
        found.selectExpr("user_id", "kind", "timestamp_micros(us) AS at", "value").write.mode("overwrite").parquet(
            f"{self.out_path}/{here}"
        )


def alert_stream(
    stream: DataFrame, out_path: str, checkpoint: str, p: AlertPolicy = AlertPolicy(), cfg: TxnConfig = TxnConfig()
):
    """(user_id, kind, at, value), appended to a table, each alert once, also when the stream is stopped and started again.

    ``busy``      a window with more than ``max_txns`` transactions; ``at`` is its start, ``value`` their number
    ``silent``    nothing for longer than ``silence`` after ``at``; told when nothing can come any more
    ``returned``  the first transaction after a silence of up to ``forget``; ``value`` are the seconds of silence

    Only closed windows count: those that the newest time less ``late`` has passed, at the end of the batch that brings it; what
    comes for them in later batches is too late. State is one row per user, and none for users who have been silent for longer
    than ``forget``; it is kept beside the checkpoint. Each batch is a folder of ``out_path``, see :func:`read_alerts`.
    """
    if window_micros(p.forget) <= window_micros(p.silence):
        raise ValueError("forget must be longer than silence")
    state = AlertState(out_path, f"{checkpoint.rstrip('/')}/alert_state", p, cfg)
    return (
        stream.writeStream.foreachBatch(state.process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_alerts(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.parquet(out_path).drop("batch")
