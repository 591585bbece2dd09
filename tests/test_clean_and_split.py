import math
import statistics

import pytest
from conftest import TXN_SCHEMA, by_id
from pyspark.sql import functions as F

from swipewatch import ScalePolicy
from swipewatch.operators import clean, encode, split
from swipewatch.plans import ranks
from swipewatch.plans.ranks import quantiles
from swipewatch.sources import demo

TINY = ScalePolicy(exact_sort_rows=50)


def _numbers(spark, values):
    return spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n long, x double")


def test_remove_missing(spark):
    df = _numbers(spark, [1.0, 2.0, float("nan"), 3.0, None, 4.0])
    assert by_id(clean.remove_missing(df, "x"), "x", "n") == [1.0, 2.0, 3.0, 4.0]


def test_value_stats(spark):
    row = clean.value_stats(_numbers(spark, [1.0, 2.0, 3.0, 4.0]), "x").first()
    assert row["sd"] == pytest.approx(1.2909944487) and row["mean"] == 2.5
    assert clean.value_stats(_numbers(spark, [1.0]), "x").first()["sd"] is None


def test_remove_outliers(spark):
    small = _numbers(spark, [1.0, 2.0, 3.0, 4.0, 100.0])
    assert clean.remove_outliers(small, "x", 2.0).count() == 5  # 100 is 1.79 deviations away
    many = _numbers(spark, [float(v % 5) for v in range(50)] + [1000.0, None])
    assert clean.remove_outliers(many, "x", 3.0).count() == 51
    assert clean.remove_outliers(_numbers(spark, [2.0, 2.0, 2.0]), "x").count() == 3
    assert clean.remove_outliers(_numbers(spark, [7.0]), "x").count() == 1


def test_remove_outliers_by_key(spark):
    rows = [("a", float(v % 3)) for v in range(30)] + [("a", 500.0), ("b", 500.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    left = clean.remove_outliers(df, "x", 3.0, by="k")
    assert left.count() == 32 and left.filter("k = 'b'").count() == 1


def test_clean_amount(spark):
    values = [float(v % 7) for v in range(40)] + [9999.0, None, float("nan")]
    got = by_id(clean.clean_amount(_numbers(spark, values), "x"), "x", "n")
    assert got[:40] == values[:40] and got[40:] == [3.0] * 3
    few = by_id(clean.clean_amount(_numbers(spark, [1.0, 2.0, 1000.0]), "x"), "x", "n")
    assert few == [1.0, 2.0, 1000.0]  # no value of fewer than 18 can be 4 deviations away
    empty = _numbers(spark, [None, None])
    assert by_id(clean.clean_amount(empty, "x"), "x", "n") == [0.0, 0.0]


def test_clean_amount_train_only(spark):
    df = _numbers(spark, [1.0, 3.0, None, 100.0])
    got = by_id(clean.clean_amount(df, "x", fit_on=df.filter("n < 3")), "x", "n")
    assert got[2] == 2.0


def test_text_amount_is_a_schema_error(spark):
    df = spark.createDataFrame([("1",)], "x string")
    with pytest.raises(TypeError):
        clean.clean_amount(df, "x")


@pytest.mark.parametrize("policy", [ScalePolicy(), TINY, ScalePolicy(exact_sort_rows=1)])
def test_quantiles_exact_on_both_paths(spark, policy):
    # a third of the rows share one value
    values = [float((v * 37) % 211) / 4 for v in range(400)] + [17.25] * 200 + [None] * 10
    df = _numbers(spark, values).withColumn("y", F.lit(None).cast("double"))
    got = quantiles(df, ["x", "y"], [0.0, 0.1, 0.25, 0.5, 0.9, 1.0], policy)
    known = sorted(v for v in values if v is not None)
    for p, value in got["x"].items():
        spot = p * (len(known) - 1)
        low, high = known[math.floor(spot)], known[math.ceil(spot)]
        assert value == pytest.approx(low + (high - low) * (spot - math.floor(spot)))
    assert got["x"][0.5] == pytest.approx(statistics.median(known))
    assert set(got["y"].values()) == {None}


@pytest.mark.parametrize("policy", [ScalePolicy(), TINY])
def test_time_split(spark, folder, policy):
    t = demo.transactions(spark, folder)
    out = split.time_split(t, 0.2, policy=policy)
    n = t.count()
    train, test = out.filter("is_train"), out.filter("NOT is_train")
    assert train.count() == int(n * 0.8) and train.count() + test.count() == n
    assert train.agg(F.max("transaction_date")).first()[0] <= test.agg(F.min("transaction_date")).first()[0]


def test_time_split_with_ties_and_missing_times(spark):
    rows = [(n, 1, 1, "2024-01-01 00:00:00" if n > 2 else None, 1.0, "USD", "approved", 0) for n in range(10)]
    out = split.time_split(spark.createDataFrame(rows, TXN_SCHEMA), 0.5)
    assert by_id(out, "is_train") == [False] * 3 + [True] * 5 + [False] * 2
    one = split.time_split(spark.createDataFrame(rows[:1], TXN_SCHEMA), 0.9)
    assert by_id(one, "is_train") == [True]
    with pytest.raises(ValueError):
        split.time_split(one.drop("is_train"), 1.5)


def test_has_times(spark, four_rows):
    assert split.has_times(four_rows)
    assert not split.has_times(four_rows.drop("transaction_date"))
    assert not split.has_times(four_rows.withColumn("transaction_date", F.lit(None).cast("string")))


@pytest.mark.parametrize("policy", [ScalePolicy(), TINY])
def test_random_split_sizes(spark, folder, policy):
    t = demo.transactions(spark, folder)
    out = split.random_split(t, 0.25, seed=7, label="fraud", policy=policy).cache()
    n = t.count()
    assert out.filter("NOT is_train").count() == math.ceil(n * 0.25)
    for r in out.groupBy("fraud").agg(F.count("*").alias("n"), F.count_if(~F.col("is_train")).alias("test")).collect():
        assert abs(r["test"] - r["n"] * 0.25) <= 1
    again = split.random_split(t.repartition(5), 0.25, seed=7, label="fraud", policy=policy)
    assert by_id(again, "is_train") == by_id(out, "is_train")
    other = split.random_split(t, 0.25, seed=8, label="fraud", policy=policy)
    assert by_id(other, "is_train") != by_id(out, "is_train")


def test_allocation_adds_up():
    assert split.allocate({0: 7, 1: 3}, 5) in ({0: 3, 1: 2}, {0: 4, 1: 1})
    assert sum(split.allocate({0: 1, 1: 1, 2: 1}, 2).values()) == 2


def test_class_of_one_row(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "transaction_id long, fraud int")
    with pytest.raises(ValueError):
        split.random_split(df, 0.5, label="fraud")
    assert split.stratify_by(df, "fraud") == "fraud"
    assert split.stratify_by(df.filter("fraud = 0"), "fraud") is None


def test_ranks_of_many_columns_with_few_passes(spark):
    """No aggregate of counts is too wide for generated code, and one round of sketches leads to the ranks."""
    n, width = 60_000, 45
    df = spark.range(n).selectExpr(*[f"cast(pmod(id * {2 * c + 7919}, {n}) AS double) AS c{c}" for c in range(width)])
    seen, found = [], type(df).agg
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(df), "agg", lambda self, *a: seen.append(len(a)) or found(self, *a))
        rules, _ = encode.fit_numeric(df, df.columns)
    want = [statistics.median(c * 1.0 for c in col) for col in zip(*[tuple(r) for r in df.collect()])]
    assert [r.median for r in rules] == want
    assert [r.scale for r in rules] == pytest.approx([statistics.pstdev(range(n))] * width, rel=1e-2)
    # counts, one round of sketches, then counts and deviations in batches
    assert max(k for k in seen if k != width) <= 4 * ranks.BATCH and len(seen) == 2 + 2 * 3


def test_ranks_beyond_every_number(spark):
    """Values that are no number are the largest ones, and a column may hold nothing else."""
    nan, tiny = float("nan"), ScalePolicy(exact_sort_rows=1)
    rows = [(float(v) if v < 1500 else nan, nan, -math.inf if v % 2 else math.inf) for v in range(4000)]
    got = quantiles(spark.createDataFrame(rows, "x double, y double, z double"), ["x", "y", "z"], [0.0, 0.25, 1.0], tiny)
    assert got["x"][0.0] == 0.0 and got["x"][0.25] == pytest.approx(999.75) and math.isnan(got["x"][1.0])
    assert all(math.isnan(v) for v in got["y"].values())
    assert got["z"] == {0.0: -math.inf, 0.25: -math.inf, 1.0: math.inf}
