"""Rolling aggregates that can't be subtracted, against loops over all rows."""

import datetime as dt
import math
import random
import statistics

import pytest
from conftest import TXN_SCHEMA
from pyspark.sql import functions as F

from swipewatch import ScalePolicy, TxnConfig
from swipewatch.operators.features import prepare
from swipewatch.operators.moving import AGGREGATES, Moving, moving

WINDOWS = {"1h": 3600, "24h": 86_400}
ALL = Moving("__amount", {a: a for a in AGGREGATES})


def prepared(df):
    return prepare(df, TxnConfig())


def rolled(df, windows=WINDOWS, columns=(ALL,), **kw):
    return moving(prepared(df), "user_id", "__time_us", "__tie", windows, columns, keep=["transaction_id"], **kw)


def moments(xs):
    n = len(xs)
    out = dict.fromkeys(("mean", "var", "std", "skew", "kurt"))
    if not n:
        return out
    mean = math.fsum(xs) / n
    m2, m3, m4 = (math.fsum((x - mean) ** p for x in xs) for p in (2, 3, 4))
    out["mean"] = mean
    if n > 1:
        out["var"], out["std"] = m2 / (n - 1), math.sqrt(m2 / (n - 1))
    if n > 2 and m2 > 0:
        out["skew"] = m3 / n / (m2 / n) ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2)
    if n > 3 and m2 > 0:
        out["kurt"] = (n - 1) / (n - 2) / (n - 3) * ((n + 1) * n * m4 / m2**2 - 3 * (n - 1))
    return out


def brute(rows, windows=WINDOWS):
    """Rows are (id, user, seconds or None, amount or None)."""
    out = {}
    for d, user, t, _ in rows:
        for label, w in windows.items():
            seen = sorted((u, e, x) for e, k, u, x in rows if None not in (k, u, x, user, t) and k == user and t - w <= u < t)
            xs = [x for *_, x in seen]
            out[d, label] = {"min": min(xs, default=None), "max": max(xs, default=None)}
            out[d, label] |= {"first": xs[0] if xs else None, "last": xs[-1] if xs else None, **moments(xs)}
    return out


def table(spark, rows):
    start = dt.datetime(2024, 1, 1)
    made = [
        (d, user, 1, None if t is None else str(start + dt.timedelta(seconds=t)), x, "USD", "approved", 0) for d, user, t, x in rows
    ]
    return spark.createDataFrame(made, TXN_SCHEMA).withColumn("transaction_date", F.col("transaction_date").cast("timestamp"))


def check(found, want, windows=WINDOWS, rel=1e-9):
    seen = 0
    for r in found:
        for label in windows:
            for agg, value in want[r["transaction_id"], label].items():
                got = r[f"{agg}_{label}"]
                assert got == (None if value is None else pytest.approx(value, rel=rel, abs=1e-7)), (agg, label, r)
                seen += got is not None
    return seen


def busy(n=400, seed=3):
    """Two thirds of the rows belong to one user, a third of them share one instant."""
    dice = random.Random(seed)
    rows = []
    for k in range(n):
        t = 43_200 if dice.random() < 0.33 else dice.randrange(-50_000, 86_400 * 3)
        user = 1 if dice.random() < 0.66 else dice.choice([2, 3, None])
        x = dice.choice([None, float("nan")]) if dice.random() < 0.1 else round(dice.uniform(1, 300), 2)
        rows.append((k, user, None if dice.random() < 0.02 else t, x))
    return rows


@pytest.mark.parametrize("limit", [10_000, 60, 17])
def test_hot_keys_and_instants(spark, limit):
    rows = busy()
    found = rolled(table(spark, rows), policy=ScalePolicy(max_group_rows=limit)).collect()
    assert len(found) == len(rows)
    want = brute([(d, u, t, None if x is None or math.isnan(x) else x) for d, u, t, x in rows])
    assert check(found, want) > 2000


def test_small_deviations_of_a_large_mean(spark):
    """Sums of squares have no digit left here; merged moments keep nine."""
    dice = random.Random(1)
    rows = [(k, 1, 60 * k, 1e9 + dice.gauss(0, 1)) for k in range(300)]
    spread = {(r["transaction_id"]): r["std_1h"] for r in rolled(table(spark, rows), {"1h": 3600}, [Moving("__amount", {"std": "std"})]).collect()}
    split = {
        (r["transaction_id"]): r["std_1h"]
        for r in rolled(table(spark, rows), {"1h": 3600}, [Moving("__amount", {"std": "std"})], policy=ScalePolicy(max_group_rows=20)).collect()
    }
    for k in range(2, 300):
        exact = statistics.stdev([x - 10**9 for _, _, _, x in rows[max(0, k - 60) : k]])
        assert spread[k] == pytest.approx(exact, rel=1e-9) and split[k] == pytest.approx(exact, rel=1e-9)


def test_equal_values_have_no_spread(spark):
    found = rolled(table(spark, [(k, 1, 60 * k, 0.1) for k in range(50)]), policy=ScalePolicy(max_group_rows=7)).collect()
    for r in found:
        if r["transaction_id"] >= 4:
            assert r["std_1h"] == 0.0 and r["skew_1h"] is None and r["kurt_24h"] is None and r["min_1h"] == r["max_1h"] == 0.1


def test_no_rows_and_bad_names(spark):
    empty = table(spark, [(1, 1, 0, 1.0)]).limit(0)
    assert rolled(empty).count() == 0
    with pytest.raises(ValueError, match="median"):
        rolled(empty, columns=[Moving("__amount", {"median": "m"})])


def test_one_exchange_for_all_windows(spark, folder):
    from swipewatch.sources import demo

    base = prepare(demo.transactions(spark, folder), TxnConfig())
    plan = moving(base, "user_id", "__time_us", "__tie", ("1h", "24h", "7d", "30d"), [ALL])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in text


def test_a_million_rows_of_one_key(spark):
    """Time grows with the rows, not with the windows' sizes: each window holds up to a third of all rows."""
    base = spark.range(1_000_000).select(
        F.col("id").alias("transaction_id"), F.lit(1).cast("long").alias("user_id"), (F.col("id") * 1_000_000).alias("t"),
        F.pmod(F.col("id") * 7919, F.lit(10_007)).cast("double").alias("x"),
    )
    out = moving(base, "user_id", "t", "transaction_id", ("4d",), [Moving("x", {"min": "lo", "std": "sd"})],
                 policy=ScalePolicy(max_group_rows=150_000), keep=["transaction_id"])
    r = out.where("transaction_id >= 10007").agg(F.count("*").alias("n"), F.min("lo_4d"), F.max("lo_4d")).first()
    assert tuple(r) == (1_000_000 - 10_007, 0.0, 0.0)


def test_tasks_go_by_the_number_of_events(spark, monkeypatch):
    """A task sorts as many events whatever the size of the table; more rows make more tasks."""
    monkeypatch.setattr("swipewatch.operators.moving.TASK_EVENTS", 500)
    rows = spark.range(2000).selectExpr("id AS transaction_id", "id % 100 AS k", "id * 1000000 AS t", "id AS i", "cast(id AS double) AS x")
    made = moving(rows, "k", "t", "i", ("1h", "2h"), [Moving("x", {"min": "lo", "mean": "mean"})], keep=["transaction_id"])
    # an event for each row and for both windows
    assert "RoundRobin" not in (plan := made._jdf.queryExecution().executedPlan().toString()) and ", 12), REPARTITION_BY_NUM" in plan
    assert made.count() == 2000


def test_what_leaves_after_the_last_row_of_a_hot_key_is_not_dealt(spark, monkeypatch):
    """A long window's leave events all lie behind the last row; its rows need their totals only."""
    monkeypatch.setattr("swipewatch.operators.moving.TASK_EVENTS", 1000)
    rows = spark.range(1000).selectExpr("id AS transaction_id", "1L AS k", "id * 1000000 AS t", "id AS i", "cast(id AS double) AS x")
    columns = [Moving("x", {"min": "lo", "max": "hi", "mean": "mean"})]
    made = moving(rows, "k", "t", "i", ("5s", "30d"), columns, policy=ScalePolicy(max_group_rows=100), keep=["transaction_id"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert ", 3), REPARTITION_BY_NUM" in plan and "__end" in plan
    found = {r["transaction_id"]: r for r in made.collect()}
    assert len(found) == 1000 and found[0]["lo_30d"] is None
    for n in range(1, 1000):
        r = found[n]
        assert (r["lo_5s"], r["hi_5s"], r["lo_30d"], r["hi_30d"]) == (max(0, n - 5), n - 1, 0, n - 1)
        assert r["mean_30d"] == pytest.approx((n - 1) / 2)
