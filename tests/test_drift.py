"""Drift of any two periods from stored day sketches against the exact index."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from swipewatch.operators.monitor import day_sketches, drift_between, stability_index
from swipewatch.sources.paths import fresh_path

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    dice = random.Random(7)
    made = []
    for k in range(20_000):
        day = dice.randrange(20)
        amount = None if k % 50 == 0 else float("nan") if k % 77 == 0 else dice.gauss(100 + 2 * day, 20)
        made.append((k, START + dt.timedelta(days=day, seconds=dice.randrange(86_400)), amount, dice.choice([1, 1, 1, 2, 5])))
    made.append((-1, None, 1e9, 9))
    return spark.createDataFrame(made, "id long, transaction_date timestamp, amount double, kind int").repartition(6).cache()


def test_any_periods(spark, rows):
    path = fresh_path(spark, "sketches")
    day_sketches(rows, ["amount", "kind"]).write.partitionBy("day").parquet(path)
    sketches = spark.read.parquet(path)
    day = F.datediff("day", F.lit("2024-01-01"))
    for first, second in (((0, 5), (5, 10)), ((0, 10), (15, 20)), ((3, 4), (19, 20)), ((0, 20), (0, 20))):
        periods = [(day >= a) & (day < b) for a, b in (first, second)]
        found = {r["feature"]: r for r in drift_between(sketches, *periods).collect()}
        dated = rows.withColumn("day", F.to_date("transaction_date"))
        both = dated.where(periods[0]).withColumn("now", F.lit(False)).union(dated.where(periods[1]).withColumn("now", F.lit(True)))
        exact = {r["feature"]: r["psi"] for r in stability_index(both, ["amount", "kind"], F.col("now")).collect()}
        for name, r in found.items():
            assert r["psi"] == pytest.approx(exact[name], abs=0.01 + 0.02 * exact[name])
            known = [both.where(~F.isnan(name) & F.col(name).isNotNull() & (F.col("now") == n)).count() for n in (False, True)]
            assert [r["n_base"], r["n_now"]] == known


def test_ranks_are_within_the_bound(spark):
    """A million values in one sketch: ranks are off by a tenth of a percent at most."""
    df = spark.range(1_000_000).select(F.lit("2024-01-01").alias("transaction_date"), F.pmod(F.col("id") * 7919, F.lit(1_000_003)).cast("double").alias("x"))
    s = day_sketches(df, ["x"]).select(F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p / 10) for p in range(1, 10)])).alias("q")).first()["q"]
    assert max(abs(v / 1_000_003 - p / 10) for v, p in zip(s, range(1, 10))) < 0.001


def test_a_period_without_rows(spark, rows):
    found = drift_between(day_sketches(rows, ["amount"]), F.col("day") < "2024-01-05", F.col("day") > "2030-01-01").first()
    assert found["n_now"] == 0 and found["n_base"] > 0 and found["psi"] is None
    assert day_sketches(rows.limit(0), ["amount"]).count() == 0
