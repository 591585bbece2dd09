"""Rolling numbers of different values and rolling quantiles, against loops over all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swipewatch import ScalePolicy
from swipewatch.operators import order_stats
from swipewatch.operators.distinct import rolling_distinct
from swipewatch.operators.order_stats import rolling_quantiles, signed_select, wavelet_select

WINDOWS = {"10s": 10, "100s": 100}


def busy(n=400, seed=5):
    """(id, key, seconds, value): one key has two thirds of the rows, one instant a fifth, few values are common."""
    dice = random.Random(seed)
    rows = []
    for d in range(n):
        t = 150 if dice.random() < 0.2 else dice.randrange(-100, 500)
        value = dice.choice([None, float("nan")]) if dice.random() < 0.08 else dice.choice([1.0, 1.0, 2.0, float(dice.randrange(50))])
        key = "hot" if dice.random() < 0.66 else dice.choice(["a", "b", None])
        rows.append((d, key, None if dice.random() < 0.03 else t, value))
    return rows


def table(spark, rows):
    df = spark.createDataFrame(rows, "id long, key string, s long, value double").repartition(3)
    return df.withColumn("t", F.col("s") * 1_000_000).withColumn("piece", F.lit("a clashing name"))


def seen(rows, row, w):
    _, key, t, _ = row
    if key is None or t is None:
        return []
    return [r for r in rows if r[1] == key and r[2] is not None and t - w <= r[2] < t]


@pytest.mark.parametrize("limit", [10_000, 40, 9])
def test_distinct(spark, limit):
    rows = [(d, k, t, None if v is None or v != v else v) for d, k, t, v in busy()]
    out = rolling_distinct(table(spark, rows), "key", "value", "t", "id", WINDOWS, "values", ScalePolicy(max_group_rows=limit)).collect()
    got = {r["id"]: r for r in out}
    assert len(out) == len(rows) and "piece" in out[0]
    for row in rows:
        for label, w in WINDOWS.items():
            inside = seen(rows, row, w)
            want = len({r[3] for r in inside if r[3] is not None}) if inside else None
            assert got[row[0]][f"values_{label}"] == want, (row, label)


@pytest.mark.parametrize("limit", [10_000, 60, 12])
def test_quantiles(spark, limit):
    rows = busy(300)
    probs = {"median": 0.5, "low": 0.1, "top": 1.0}
    out = rolling_quantiles(table(spark, rows), "key", "value", "t", WINDOWS, probs, ScalePolicy(max_group_rows=limit)).collect()
    got = {r["id"]: r for r in out}
    assert len(out) == len(rows) and out[0]["piece"] == "a clashing name"
    for row in rows:
        for label, w in WINDOWS.items():
            xs = [r[3] for r in seen(rows, row, w) if r[3] is not None and r[3] == r[3]]
            for prefix, p in probs.items():
                want = pytest.approx(float(np.quantile(xs, p)), abs=1e-12) if xs else None
                assert got[row[0]][f"{prefix}_{label}"] == want, (row, label, prefix)


def test_one_value_everywhere(spark):
    rows = [(d, "k", d, 7.0) for d in range(100)]
    out = rolling_quantiles(table(spark, rows), "key", "value", "t", {"10s": 10}, {"m": 0.5}, ScalePolicy(max_group_rows=5)).collect()
    assert {r["id"]: r["m_10s"] for r in out} == {d: 7.0 if d else None for d in range(100)}


def test_no_rows(spark):
    none = table(spark, busy(5)).limit(0)
    assert rolling_quantiles(none, "key", "value", "t", WINDOWS, {"m": 0.5}).count() == 0
    assert rolling_distinct(none, "key", "value", "t", "id", WINDOWS, "n").count() == 0


def test_wavelet_select():
    dice = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        values = dice.integers(0, 9, n).astype(float)
        first = dice.integers(0, n, 50)
        end = first + 1 + dice.integers(0, n, 50) % (n - first)
        rank = dice.integers(0, end - first)
        want = [sorted(values[a:b])[k] for a, b, k in zip(first, end, rank)]
        assert wavelet_select(values, first, end, rank).tolist() == want


def test_a_hot_key_of_many_rows(spark):
    """200,000 rows of one key, a third of which is in every window; the stream is cut by value twice."""
    base = spark.range(200_000).select(
        "id", F.lit("k").alias("key"), (F.col("id") * 1_000_000).alias("t"), F.pmod(F.col("id") * 7919, F.lit(1009)).cast("double").alias("value")
    )
    policy = ScalePolicy(max_group_rows=20_000)
    out = rolling_quantiles(base, "key", "value", "t", ["60540s"], {"m": 0.5}, policy, keep=["id"])
    # any 1009 rows in a row hold each value once
    r = out.where("id >= 60540").agg(F.count("*"), F.min("m_60540s"), F.max("m_60540s")).first()
    assert tuple(r) == (200_000 - 60_540, 504.0, 504.0)
    d = rolling_distinct(base, "key", "value", "t", "id", ["60540s"], "n", policy, keep=["id"])
    assert tuple(d.where("id >= 1009").agg(F.min("n_60540s"), F.max("n_60540s")).first()) == (1009, 1009)


def test_what_leaves_after_the_last_row_of_a_hot_key_is_not_kept(spark, monkeypatch):
    """Tasks go by the number of events, and no chunk holds the changes that nobody asks for."""
    monkeypatch.setattr("swipewatch.operators.distinct.TASK_EVENTS", 1000)
    rows = spark.range(1000).selectExpr("id AS transaction_id", "1L AS k", "id % 7 AS v", "id * 1000000 AS t", "id AS i")
    made = rolling_distinct(rows, "k", "v", "t", "i", ("5s", "30d"), "seen", ScalePolicy(max_group_rows=100), ["transaction_id"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert ", 7), REPARTITION_BY_NUM" in plan and "__end" in plan
    found = [tuple(r) for r in made.orderBy("transaction_id").collect()]
    assert found == [(n, None if not n else min(n, 5), None if not n else min(n, 7)) for n in range(1000)]


def test_signed_select():
    dice = np.random.default_rng(2)
    for width in (1, 2, 5, 33):
        start = dice.integers(0, 4, width)
        held, pieces, signs, counts = start.copy(), [], [], [start.copy()]
        for _ in range(60):
            c = int(dice.integers(0, width))
            sign = int(dice.integers(1, 3)) if held[c] == 0 or dice.random() < 0.5 else -1
            held[c] += sign
            pieces.append(c), signs.append(sign), counts.append(held.copy())
        asked = [(at, r) for at, n in enumerate(counts) for r in range(n.sum())]
        found = signed_select(np.array(pieces), np.array(signs), start, *(np.array(a) for a in zip(*asked)))
        for (at, r), c, rest in zip(asked, *found):
            assert counts[at][:c].sum() + rest == r and 0 <= rest < counts[at][c]


@pytest.mark.parametrize("rows_of_a_piece", [1_000_000, 5])
def test_long_keys_are_divided_once(spark, monkeypatch, rows_of_a_piece):
    """Pieces that fit a task are not divided again, however small the limit; longer ones are."""
    divided, whole = [], order_stats._divided
    monkeypatch.setattr(order_stats, "_divided", lambda *a: divided.append(1) or whole(*a))
    monkeypatch.setattr(order_stats, "PIECE_ROWS", rows_of_a_piece)
    monkeypatch.setattr(order_stats, "PARTS", 4)
    monkeypatch.setattr(order_stats, "CHUNK_SHARE", 1)
    rows = [(d, "hot" if d % 5 else "a", d % 150, float(d * 7919 % 211)) for d in range(400)]
    out = rolling_quantiles(table(spark, rows), "key", "value", "t", WINDOWS, {"m": 0.5, "top": 0.9}, ScalePolicy(max_group_rows=5))
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows) and bool(divided) == (rows_of_a_piece == 5)
    for row in rows:
        for label, w in WINDOWS.items():
            xs = [r[3] for r in seen(rows, row, w)]
            for prefix, p in (("m", 0.5), ("top", 0.9)):
                want = pytest.approx(float(np.quantile(xs, p)), abs=1e-9) if xs else None
                assert got[row[0]][f"{prefix}_{label}"] == want
