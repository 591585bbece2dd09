import datetime as dt
import random

import pytest
from conftest import TXN_SCHEMA, by_id
from pyspark.sql import functions as F

from swipewatch import ScalePolicy, TxnConfig
from swipewatch.functions.scalars import window_micros
from swipewatch.operators.features import add_features, feature_names
from swipewatch.plans.chunks import plan_chunks
from swipewatch.sources import demo

HOUR = TxnConfig(windows=("1h",))


def test_golden_rows(four_rows):
    out = add_features(four_rows, HOUR).cache()
    expected = {
        "user_txn_count_1h": [None, 1, None, None],
        "user_amount_sum_1h": [None, 100.0, None, None],
        "user_amount_mean_1h": [None, 100.0, None, None],
        "user_time_since_last_txn": [None, 1800.0, 5400.0, None],
        "merchant_txn_count_1h": [None, 2, None, 1],
        "merchant_amount_mean_1h": [None, 75.0, None, 100.0],
        "merchant_fraud_rate_1h": [None, 0.0, None, 0.0],
        "currency_txn_count_1h": [None, 1, None, None],
        "status_txn_count_1h": [None, 2, None, 1],
    }
    for column, values in expected.items():
        assert by_id(out, column) == values, column
    z = by_id(out, "user_amount_zscore")
    assert z[:2] == [None, None] and z[3] is None
    assert z[2] == pytest.approx((200 - 125) / 35.35533905932738)


def _series(spark, times, amounts, **extra):
    rows = [(n, 1, None, f"2024-01-01 {t}", a, None, None, 0) for n, (t, a) in enumerate(zip(times, amounts), 1)]
    return spark.createDataFrame(rows, TXN_SCHEMA)


def test_left_edge_is_in_and_own_row_is_out(spark):
    df = _series(spark, ["00:00:00", "01:00:00", "01:30:00", "03:00:00"], [1.0, 2.0, 4.0, 8.0])
    out = add_features(df, HOUR, ("user",))
    assert by_id(out, "user_txn_count_1h") == [None, 1, 1, None]
    assert by_id(out, "user_amount_sum_1h") == [None, 1.0, 2.0, None]


def test_missing_amounts_count_as_rows_without_value(spark):
    df = _series(spark, ["00:00:00", "00:10:00", "00:20:00"], [None, None, 4.0])
    out = add_features(df, HOUR, ("user",))
    assert by_id(out, "user_txn_count_1h") == [None, 0, 0]
    assert by_id(out, "user_amount_sum_1h") == [None, None, None]


def test_nan_is_missing(spark):
    df = _series(spark, ["00:00:00", "00:10:00"], [float("nan"), 4.0])
    assert by_id(add_features(df, HOUR, ("user",)), "user_txn_count_1h") == [None, 0]


def test_tied_rows_do_not_see_each_other(spark):
    df = _series(spark, ["00:00:00", "00:30:00", "00:30:00", "00:40:00"], [1.0, 2.0, 3.0, 4.0])
    assert by_id(add_features(df, HOUR, ("user",)), "user_txn_count_1h") == [None, 1, 1, 3]


def test_constant_amounts_have_no_zscore(spark):
    df = _series(spark, ["00:00:00", "00:10:00", "00:20:00", "00:30:00"], [0.1] * 4)
    assert by_id(add_features(df, HOUR, ("user",)), "user_amount_zscore") == [None] * 4


def test_constant_amounts_of_a_hot_key_have_no_zscore(spark):
    rows = [(n, 1, 1, f"2024-01-01 {n // 60:02d}:{n % 60:02d}:00", 0.1, "USD", "approved", 0) for n in range(300)]
    df = spark.createDataFrame(rows, TXN_SCHEMA)
    out = add_features(df, HOUR, ("user",), ScalePolicy(max_group_rows=20))
    assert by_id(out, "user_amount_zscore") == [None] * 300
    assert by_id(out, "user_txn_count_1h")[-1] == 60


def test_null_key_and_null_time_keep_their_rows(spark):
    rows = [
        (1, None, 10, "2024-01-01 00:00:00", 1.0, "USD", "approved", 0),
        (2, None, 10, "2024-01-01 00:10:00", 2.0, "USD", "approved", 0),
        (3, 5, 10, "not a time", 3.0, "USD", "approved", 0),
        (4, 5, 10, "2024-01-01 00:20:00", 4.0, "USD", "approved", 0),
    ]
    df = spark.createDataFrame(rows, TXN_SCHEMA)
    out = add_features(df, HOUR.with_(on_bad_time="null")).cache()
    assert by_id(out, "transaction_id") == [1, 2, 3, 4]
    assert by_id(out, "user_txn_count_1h") == [None] * 4
    assert by_id(out, "merchant_txn_count_1h") == [None, 1, None, 2]
    with pytest.raises(Exception, match="unreadable time"):
        add_features(df, HOUR).collect()


def test_absent_columns_switch_families_off(four_rows):
    out = add_features(four_rows.drop("merchant_id", "fraud"), HOUR)
    assert not [c for c in out.columns if c.startswith("merchant_")]
    assert add_features(four_rows.drop("amount"), HOUR).columns == four_rows.drop("amount").columns
    assert [c for c in add_features(four_rows.drop("fraud"), HOUR).columns if "fraud_rate" in c] == []
    assert add_features(four_rows, TxnConfig(windows=())).columns[-2:] == [
        "user_time_since_last_txn",
        "user_amount_zscore",
    ]


def test_default_features_are_34(four_rows):
    assert len(feature_names(four_rows.columns, TxnConfig())) == 34


@pytest.mark.parametrize("bad", ["7", "-1h", "2 hours", "", "h", "0d", None])
def test_bad_windows(bad):
    with pytest.raises(ValueError):
        window_micros(bad)


def test_windows():
    assert window_micros("1h") == 3_600_000_000
    assert window_micros("30min") == window_micros(dt.timedelta(minutes=30))
    with pytest.raises(ValueError):
        window_micros(dt.timedelta(0))


def test_label_delay(spark):
    rows = [(n, 1, 9, f"2024-01-01 0{n}:00:00", 1.0, "USD", "approved", n % 2) for n in range(1, 6)]
    df = spark.createDataFrame(rows, TXN_SCHEMA)
    out = add_features(df, TxnConfig(windows=("3h",), label_delay="2h"), ("merchant",))
    # at n the labels of n-3 and, being exactly 2h old, not yet that of n-2
    assert by_id(out, "merchant_fraud_rate_3h") == [None, None, None, 1.0, 0.0]


def _busy(spark, n=400, seed=3):
    """Two thirds of the rows belong to one user; a third share one instant."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        second = 43_200 if rng.random() < 0.33 else rng.randrange(86_400 * 3)
        user = 1 if rng.random() < 0.66 else rng.choice([2, 3, 4, None])
        amount = None if rng.random() < 0.1 else round(rng.uniform(1, 300), 2)
        time = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)
        rows.append((k, user, rng.choice([1, 1, 1, 2]), str(time), amount, "USD", "approved", rng.randrange(2)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, TXN_SCHEMA), rows


def _brute(rows, windows):
    out = {}
    for me in rows:
        t = dt.datetime.fromisoformat(me[3])
        past = [r for r in rows if r[1] == me[1] and (r[3], r[0]) < (me[3], me[0])] if me[1] is not None else []
        row = {}
        for label, span in windows.items():
            seen = [r for r in past if t - span <= dt.datetime.fromisoformat(r[3]) < t]
            amounts = [r[4] for r in seen if r[4] is not None]
            row[f"user_txn_count_{label}"] = len(amounts) if seen else None
            row[f"user_amount_sum_{label}"] = sum(amounts) if amounts else None
        known = [r[4] for r in past if r[4] is not None]
        sd = None
        if len(known) > 1:
            mean = sum(known) / len(known)
            sd = (sum((x - mean) ** 2 for x in known) / (len(known) - 1)) ** 0.5
        row["user_amount_zscore"] = (me[4] - mean) / sd if sd and me[4] is not None else None
        last = max((r[3] for r in past), default=None)
        row["user_time_since_last_txn"] = (t - dt.datetime.fromisoformat(last)).total_seconds() if last else None
        out[me[0]] = row
    return out


@pytest.mark.parametrize("limit", [10_000, 50, 13])
def test_hot_key_and_hot_instant_equal_brute_force(spark, limit):
    df, rows = _busy(spark)
    windows = {"1h": dt.timedelta(hours=1), "24h": dt.timedelta(hours=24)}
    policy = ScalePolicy(max_group_rows=limit)
    out = add_features(df, TxnConfig(windows=tuple(windows)), ("user",), policy).collect()
    expected = _brute(rows, windows)
    assert len(out) == len(rows)
    for r in out:
        for column, value in expected[r["transaction_id"]].items():
            assert r[column] == (pytest.approx(value, abs=1e-9) if value is not None else None), (column, r)


def test_chunks_of_a_hot_key_are_bounded(spark):
    df, _ = _busy(spark, 3000)
    rows = df.select(
        F.col("user_id").alias("k"),
        F.unix_micros(F.col("transaction_date").cast("timestamp")).alias("t"),
        F.col("transaction_id").alias("i"),
    )
    plan = plan_chunks(rows, "k", "t", "i", ScalePolicy(max_group_rows=100))
    assert not plan.empty and plan.chunk_count <= 2 * 3000 // 100 + len(plan.points)
    sizes = plan.attach(rows.filter("k IS NOT NULL"), "k", "t", "i").groupBy("k", "__chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 250
    assert sizes.agg(F.sum("count")).first()[0] == rows.filter("k IS NOT NULL").count()


def test_split_plan_equals_plain_plan_on_the_stored_table(spark, folder):
    t = demo.transactions(spark, folder)
    plain = add_features(t)
    split = add_features(t, policy=ScalePolicy(max_group_rows=60))
    a = {r["transaction_id"]: r for r in plain.collect()}
    b = {r["transaction_id"]: r for r in split.collect()}
    assert a.keys() == b.keys()
    for k, row in a.items():
        for c in plain.columns:
            x, y = row[c], b[k][c]
            assert x == (pytest.approx(y, rel=1e-9) if isinstance(y, float) else y), (k, c)


def test_one_exchange_per_family(spark, folder):
    plan = add_features(demo.transactions(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4
    assert "SinglePartition" not in plan
