"""Streaming: score transactions, add behavioural features, watch activity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_POLICY, ScalePolicy, TxnConfig
from ..functions.scalars import micros, window_micros
from ..operators.features import add_features, merge_summaries, summarize_users
from ..operators.models import score
from ..operators.monitor import window_activity
from ..sources.paths import folders, remove

EPOCH = dt.date(1970, 1, 1)
DAY_MICROS = 86_400_000_000


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def score_stream(stream: DataFrame, encoder, model, out_path: str, checkpoint: str, keep=("transaction_id",)):
    """Encode and score each transaction; append ``keep, prediction, score`` to a table."""
    scored = score(model, encoder.transform(stream)).select(*keep, "prediction", "score")
    return (
        scored.writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def labelled_stream(
    scores: DataFrame,
    labels: DataFrame,
    out_path: str,
    checkpoint: str,
    limit: str = "7 days",
    late: str = "1 hour",
    id_: str = TxnConfig.id,
    time: str = TxnConfig.time,
    labelled_at: str = "labelled_at",
):
    """Scored transactions with labels that arrive up to ``limit`` after them; appended to a table.

    A row is written when its label comes, or without one when none can come any more: both streams have passed its time,
    the limit and ``late``. Until then it is state, so state holds no more than the limit. Labels from before their transaction
    or beyond the limit are not used. The table read by ``monitor.metrics_per_day`` is the model's performance.
    """
    s = scores.withWatermark(time, late)
    m = labels.withColumnRenamed(id_, "__labelled_id").withWatermark(labelled_at, late)
    near = F.expr(f"{id_} = __labelled_id AND {labelled_at} >= {time} AND {labelled_at} <= {time} + INTERVAL {limit}")
    joined = s.join(m, near, "left_outer").drop("__labelled_id")
    return (
        joined.writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def activity_stream(
    stream: DataFrame, out_path: str, checkpoint: str, width="1 hour", late="1 hour", cfg: TxnConfig = TxnConfig()
):
    """Tumbling-window activity; a window is written once, when the watermark has passed it."""
    activity = window_activity(stream.withWatermark(cfg.time, late), width, cfg.time, cfg.amount, cfg.label)
    return (
        activity.writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


class FeatureStream:
    """User and merchant features of a transaction stream, equal to those of the batch job.

    Rows may arrive out of order by up to ``late``. A row is held back until the newest time seen
    is more than ``late`` after it; then everything before it has arrived, and it is emitted once.
    :meth:`finish` emits what is still held back when the stream has ended. Rows without a time
    have no features and are emitted at once; ids may repeat or be missing.

    The state is kept in tables under ``path``. Every write names its micro-batch, so that a
    repeated micro-batch overwrites itself:

    ``pending``    rows held back, as of the batch
    ``rows``       rows emitted, by day; a batch lists and reads only the days it looks back to
    ``summaries``  mergeable history per user and day
    ``history``    one summary per user of all days before the oldest look-back day
    ``late``       rows that came after their time had been passed; kept, not scored
    ``progress``   the newest time seen

    Days that fall out of the look-back are merged into ``history`` and their files removed, so
    what a batch reads depends on the look-back and not on how long the stream has run.

    Per batch the batch operator runs once on the ready rows. What it looks back to is summed up per key as of the
    oldest instant that can be ready; look-back rows take part in the batch only where they leave a window during it.
    A hot key is cut into chunks here as well, and no key's history has to fit into the state of one task.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        cfg: TxnConfig = TxnConfig(),
        late: str = "1h",
        families=("user", "merchant"),
        policy: ScalePolicy = DEFAULT_POLICY,
    ):
        self.spark, self.path, self.cfg = spark, path.rstrip("/"), cfg
        self.late, self.families, self.policy = window_micros(late), families, policy
        self.look_back = max([window_micros(w) for w in cfg.windows], default=0)
        if cfg.label_delay:
            self.look_back += window_micros(cfg.label_delay)

    def start(self, stream: DataFrame, checkpoint: str):
        return (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def features(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/features").drop("batch")

    # --- tables -----------------------------------------------------------------------

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def _write_days(self, df: DataFrame, table: str, batch: int) -> None:
        """Write ``day=/batch=`` folders, replacing just those of this batch; few files per day."""
        df.withColumn("batch", F.lit(batch)).hint("rebalance", "day").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("day", "batch").parquet(f"{self.path}/{table}")

    def _numbers(self, table: str) -> list:
        return sorted(int(d.split("=")[1]) for d in folders(self.spark, f"{self.path}/{table}") if "=" in d)

    def _latest(self, table: str, before: int) -> DataFrame | None:
        """What the batch before left; older batches' tables are removed."""
        numbers = [n for n in self._numbers(table) if n < before]
        for n in numbers[:-1]:
            remove(self.spark, f"{self.path}/{table}/batch={n}")
        return self.spark.read.parquet(f"{self.path}/{table}/batch={numbers[-1]}") if numbers else None

    def _read_days(self, table: str, before: int, wanted) -> DataFrame | None:
        """``day=/batch=`` folders of earlier batches, listing only days that ``wanted`` accepts."""
        root = f"{self.path}/{table}"
        days = [f"{root}/{d}" for d in folders(self.spark, root) if d.startswith("day=") and wanted(d[4:])]
        if not days:
            return None
        read = self.spark.read.option("basePath", root).parquet(*days)
        return read.withColumn("day", F.col("day").cast("date")).filter(F.col("batch") < before).drop("batch")

    def _history(self, before: int, limit: int | None) -> tuple:
        """(first day kept by day, summary of all days before it); closed days are merged here.

        ``limit``: no row before it is ever emitted again. It comes from the batch before, so a
        repeated batch finds and makes the same.
        """
        kept = [d.split("=")[1] for d in folders(self.spark, f"{self.path}/history")]
        upto = max(kept, default=None)
        old = self.spark.read.parquet(f"{self.path}/history/upto={upto}") if upto else None
        if limit is None:
            return upto or "", old
        first = str(EPOCH + dt.timedelta(days=(limit - self.look_back) // DAY_MICROS))
        closed = self._read_days("summaries", before, lambda day: (upto or "") <= day < first)
        if closed is None:
            return upto or "", old
        whole = closed.select("k", "n", "mean", "m2", "last_t", "lo", "hi")
        merge_summaries(whole if old is None else whole.unionByName(old)).write.mode("overwrite").parquet(
            f"{self.path}/history/upto={first}"
        )
        for table in ("summaries", "rows"):
            for d in folders(self.spark, f"{self.path}/{table}"):
                if d.startswith("day=") and d[4:] < first:
                    remove(self.spark, f"{self.path}/{table}/{d}")
        if upto:
            remove(self.spark, f"{self.path}/history/upto={upto}")
        return first, self.spark.read.parquet(f"{self.path}/history/upto={first}")

    # --- batches ----------------------------------------------------------------------

    def process(self, rows: DataFrame, batch: int) -> None:
        t = micros(F.col(self.cfg.time))
        progress = self._latest("progress", batch)
        seen = progress.first()["newest"] if progress is not None else None
        passed = None if seen is None else seen - self.late
        in_time = F.lit(True) if passed is None else F.coalesce(t >= passed, F.lit(True))
        self._write(rows.filter(~in_time), "late", batch)
        arrived = rows.filter(in_time)
        pending = self._latest("pending", batch)
        if pending is not None:
            arrived = arrived.unionByName(pending)
        # written once, so that a row's fate is the same in all that follows
        self._write(arrived, "arrived", batch)
        self._latest("arrived", batch)
        arrived = self.spark.read.parquet(f"{self.path}/arrived/batch={batch}")
        newest = arrived.agg(F.max(t)).first()[0]
        newest = seen if newest is None else max(newest, seen if seen is not None else newest)
        ready = F.lit(True) if newest is None else F.coalesce(t < newest - self.late, F.lit(True))
        self._emit(arrived.filter(ready), batch, passed)
        self._write(arrived.filter(~ready), "pending", batch)
        self._write(self.spark.createDataFrame([(newest,)], "newest long"), "progress", batch)

    def finish(self) -> None:
        """Emit what is held back: the stream has ended."""
        last = max(self._numbers("progress"), default=None)
        if last is None:
            return
        progress, pending = self._latest("progress", last + 1), self._latest("pending", last + 1)
        newest = progress.first()["newest"]
        self._emit(pending, last + 1, None if newest is None else newest - self.late)
        self._write(pending.limit(0), "pending", last + 1)
        # nothing at or before the newest time is expected any more
        ended = None if newest is None else newest + self.late + 1
        self._write(self.spark.createDataFrame([(ended,)], "newest long"), "progress", last + 1)

    def _emit(self, ready: DataFrame, batch: int, passed: int | None) -> None:
        cfg, t = self.cfg, micros(F.col(self.cfg.time))
        if ready.isEmpty():
            return
        first, older = self._history(batch, passed)
        past = self._read_days("rows", batch, lambda day: day >= first)
        # all that was emitted lies before all that is ready: it is summed up per key and not rolled again
        past = None if past is None else past.drop("day")
        users = ready.select(F.col(cfg.user).alias("k")).distinct()
        if past is not None:
            mine = summarize_users(past, cfg)
            older = mine if older is None else merge_summaries(mine.unionByName(older))
        if older is not None:
            older = older.join(users, "k", "left_semi")
        made = add_features(ready, cfg, self.families, self.policy, older, past, passed)
        names = [c for c in made.columns if c not in ready.columns]
        names = [c for c in made.columns if c not in ready.columns and c != "__here"]
        self._write(made.select(cfg.id, *names), "features", batch)
        dated = ready.filter(t.isNotNull()).withColumn("day", F.to_date(cfg.time))
        self._write_days(dated, "rows", batch)
        self._write_days(summarize_users(dated, cfg, ["day"]), "summaries", batch)
