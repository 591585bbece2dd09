"""Alerts of a stream in several runs equal those found by a plain loop over all rows of closed windows."""

import datetime as dt

import pytest

from swipewatch.config import TxnConfig
from swipewatch.sources.paths import fresh_path
from swipewatch.streaming.alerts import AlertPolicy, AlertState, alert_stream, read_alerts
from swipewatch.streaming.jobs import read_stream

SCHEMA = "transaction_id long, user_id string, transaction_date timestamp"
START = dt.datetime(2024, 1, 1)
HOUR = 3600


def plain(rows, p_txns, width, silence, forget, mark):
    """Alerts as (user, kind, second, value) of rows (user, second), with the watermark at second ``mark``."""
    closed = {}
    for user, t in rows:
        if user is not None and t is not None and (t // width + 1) * width <= mark:
            closed.setdefault(user, []).append(t)
    out = set()
    for user, times in closed.items():
        times.sort()
        for w in {t // width for t in times}:
            n = sum(t // width == w for t in times)
            if n > p_txns:
                out.add((user, "busy", w * width, n))
        for a, b in zip(times, times[1:]):
            if b - a > silence:
                out.add((user, "silent", a, None))
                if b - a <= forget:
                    out.add((user, "returned", b, b - a))
        if ((times[-1] + silence) // width + 1) * width <= mark:
            out.add((user, "silent", times[-1], None))
    return out


@pytest.mark.parametrize("batches_per_run", [1, 2])
def test_alerts_over_restarts(spark, batches_per_run):
    root = fresh_path(spark, "user_alerts")
    p = AlertPolicy(width="1h", max_txns=3, silence="5h", forget="30h", late="2h")
    parts = [
        # a is busy; d has one row; rows without user or time
        [("a", 60 * m) for m in (1, 2, 3, 50)] + [("b", 100), ("b", 59 * 60), ("c", 30), (None, 5), ("d", 7)],
        # b comes back after exactly the silence (no alert), c one second later than that; out of order by an hour
        [("b", 59 * 60 + 5 * HOUR), ("c", 30 + 5 * HOUR + 1), ("a", 5 * HOUR), ("a", 4 * HOUR + 60), ("a", None)],
        # a hot user, busy in one window, with all its rows in one batch
        [("hot", 20 * HOUR + k) for k in range(3000)] + [("b", 12 * HOUR + 1), ("b", 19 * HOUR)],
        # back after more than it takes to be forgotten, and within it
        [("d", 40 * HOUR), ("hot", 41 * HOUR), ("hot", 41 * HOUR), ("c", 39 * HOUR)],
        [("e", 90 * HOUR)],
    ]
    schema = spark.createDataFrame([], SCHEMA).schema
    for k in range(0, len(parts), batches_per_run):
        for part in parts[k : k + batches_per_run]:
            rows = [(0, u, None if t is None else START + dt.timedelta(seconds=t)) for u, t in part]
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = read_stream(spark, f"{root}/in", schema, files_per_batch=1)
        alert_stream(stream, f"{root}/out", f"{root}/checkpoint", p).awaitTermination()
    got = [
        (r["user_id"], r["kind"], int((r["at"] - START).total_seconds()), r["value"])
        for r in spark.read.parquet(f"{root}/out").collect()
    ]
    assert len(got) == len(set(got))
    assert set(got) == plain([x for part in parts for x in part], 3, HOUR, 5 * HOUR, 30 * HOUR, 88 * HOUR)
    assert {k for _, k, _, _ in got} == {"busy", "silent", "returned"}


def test_forgetting_comes_after_silence(spark):
    with pytest.raises(ValueError):
        alert_stream(spark.readStream.format("rate").load(), "x", "y", AlertPolicy(silence="7d", forget="1d"))


def test_no_step_and_no_store_per_user(spark):
    """A batch is joins of whole tables: no state store of the stream is asked user by user."""
    root = fresh_path(spark, "many_users")
    rows = spark.range(4000).selectExpr("id AS transaction_id", "cast(id % 2000 AS string) AS user_id", "timestamp_seconds(id) AS transaction_date")
    rows.write.parquet(f"{root}/in")
    run = alert_stream(read_stream(spark, f"{root}/in", rows.schema), f"{root}/out", f"{root}/checkpoint", AlertPolicy(late="1s", width="1s"))
    run.awaitTermination()
    assert not [s for progress in run.recentProgress for s in progress["stateOperators"]]


def test_a_repeated_batch_changes_nothing(spark):
    root = fresh_path(spark, "repeated_alerts")
    state = AlertState(f"{root}/out", f"{root}/state", AlertPolicy("1h", 1, "5h", "30h", "1h"), TxnConfig())
    for batch, seconds in enumerate([[1, 2, 5 * HOUR], [3 * HOUR, 11 * HOUR], [40 * HOUR]]):
        rows = spark.createDataFrame([(0, "a", START + dt.timedelta(seconds=s)) for s in seconds], SCHEMA)
        seen = []
        for _ in range(2):
            state.process(rows, batch)
            found = read_alerts(spark, f"{root}/out").selectExpr("kind", "cast(at AS string)", "value").collect()
            seen.append(sorted((r["kind"], r["at"], r["value"]) for r in found))
        assert seen[0] == seen[1]
    # the row at 3 h came after its window was closed; the silence of 11 h is told by the row at 40 h
    assert [(kind, value) for kind, _, value in seen[-1]] == [("busy", 2), ("returned", 6 * HOUR), ("silent", None), ("silent", None)]
