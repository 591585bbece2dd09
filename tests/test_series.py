import random

import pytest

from swipewatch import ScalePolicy
from swipewatch.operators.series import exponential_average, moving_average, relative_strength


def _frame(spark, values, key="a"):
    return spark.createDataFrame([(key, n, float(v)) for n, v in enumerate(values)], "key string, pos long, value double")


def _values(df, column):
    return [r[column] for r in df.orderBy("key", "pos").collect()]


def test_goldens(spark):
    df = _frame(spark, range(1, 6))
    assert _values(moving_average(df, "key", "pos", "value", 3, "pos"), "moving_average") == [2, 3, 4]
    assert _values(exponential_average(df, "key", "pos", "value", 0.5, "pos"), "ema") == [1, 1.5, 2.25, 3.125, 4.0625]
    up = _frame(spark, range(1, 11))
    assert _values(relative_strength(up, "key", "pos", "value", 3, "pos"), "rsi") == [100.0] * 8
    zigzag = _frame(spark, [1, 3, 2, 5, 4])
    got = _values(relative_strength(zigzag, "key", "pos", "value", 3, "pos"), "rsi")
    assert got == pytest.approx([66.6666667, 86.6666667, 66.6666667])
    flat = _frame(spark, [2, 2, 2, 2])
    assert _values(relative_strength(flat, "key", "pos", "value", 3, "pos"), "rsi") == [100.0, 100.0]


def test_lone_series_without_key(spark):
    df = _frame(spark, range(1, 6))
    assert _values(moving_average(df, None, "pos", "value", 3, "pos"), "moving_average") == [2, 3, 4]
    with pytest.raises(ValueError):
        moving_average(df, None, "pos", "value", 6, "pos")


@pytest.mark.parametrize("alpha", [0.0, 1.0])
def test_alpha_limits(spark, alpha):
    got = _values(exponential_average(_frame(spark, [3, 1, 2]), "key", "pos", "value", alpha, "pos"), "ema")
    assert got == ([3, 3, 3] if alpha == 0 else [3, 1, 2])


def test_bad_parameters(spark):
    df = _frame(spark, [1, 2, 3])
    for call in (
        lambda: moving_average(df, "key", "pos", "value", 0, "pos"),
        lambda: exponential_average(df, "key", "pos", "value", 1.5, "pos"),
        lambda: exponential_average(df, "key", "pos", "value", -0.1, "pos"),
        lambda: relative_strength(df, "key", "pos", "value", 1, "pos"),
    ):
        with pytest.raises(ValueError):
            call()


def _ema(values, alpha):
    out = [values[0]]
    for x in values[1:]:
        out.append(alpha * x + (1 - alpha) * out[-1])
    return out


def _rsi(values, n):
    moves = [b - a for a, b in zip(values, values[1:])]
    gain = sum(max(m, 0) for m in moves[: n - 1]) / n
    loss = sum(max(-m, 0) for m in moves[: n - 1]) / n
    out = [100 if loss == 0 else 100 - 100 / (1 + gain / loss)]
    for m in moves[n - 1 :]:
        gain, loss = (gain * (n - 1) + max(m, 0)) / n, (loss * (n - 1) + max(-m, 0)) / n
        out.append(100 if loss == 0 else 100 - 100 / (1 + gain / loss))
    return out


@pytest.fixture(params=[10_000, 16], ids=["one batch", "many batches"])
def arrow_batch(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, before)


@pytest.mark.parametrize("limit", [10_000, 40, 7])
def test_long_series_in_blocks_equal_the_sequential_result(spark, limit, arrow_batch):
    rng = random.Random(5)
    series = {"a": [round(rng.uniform(1, 100), 2) for _ in range(300)], "b": [1.0, 2.0], "c": [5.0] * 30}
    rows = [(k, n, v) for k, vs in series.items() for n, v in enumerate(vs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, pos long, value double")
    policy = ScalePolicy(max_group_rows=limit)
    for alpha in (0.3, 0.01, 0.0, 1.0):
        got = _values(exponential_average(df, "key", "pos", "value", alpha, "pos", policy=policy), "ema")
        assert got == pytest.approx([x for k in "abc" for x in _ema(series[k], alpha)])
    got = _values(relative_strength(df, "key", "pos", "value", 5, "pos", policy=policy), "rsi")
    assert got == pytest.approx([x for k in "ac" for x in _rsi(series[k], 5)])
    got = _values(moving_average(df, "key", "pos", "value", 5, "pos", policy=policy), "moving_average")
    expected = [sum(series[k][n - 4 : n + 1]) / 5 for k in "ac" for n in range(4, len(series[k]))]
    assert got == pytest.approx(expected)
