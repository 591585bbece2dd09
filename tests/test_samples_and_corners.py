"""Samples per class, corners of the ROC curve, refused class columns."""

import random

import pytest
from pyspark.sql import functions as F

from swipewatch import ScalePolicy
from swipewatch.operators import metrics, models, profile


def test_sample_is_the_same_on_any_partitioning(spark):
    rows = [(k, ["a", "b", None][min(k % 10, 2)], k) for k in range(500)] + [(1000, "rare", 1)]
    df = spark.createDataFrame(rows, "id long, label string, place int")
    one, many = (
        sorted(tuple(r) for r in profile.sample_by_label(df.repartition(n), "label", 20, "id").select("label", "id").collect() if r[0])
        for n in (1, 9)
    )
    assert one == many and [x for x in one if x[0] == "rare"] == [("rare", 1000)] and len(one) == 41
    whole = profile.sample_by_label(df, "label", 20, "id")
    assert whole.columns == df.columns and whole.where("label IS NULL").count() == 20
    # the sample of a union comes from the samples of its parts
    parts = [profile.sample_by_label(df.where(w), "label", 20, "id") for w in ("id % 2 = 0", "id % 2 = 1")]
    again = profile.sample_by_label(parts[0].union(parts[1]), "label", 20, "id")
    assert {r["id"] for r in again.collect()} == {r["id"] for r in whole.collect()}


def test_tasks_pass_on_few_rows(spark):
    df = spark.range(10_000).select("id", (F.col("id") % 3).alias("label"))
    plan = profile.sample_by_label(df, "label", 5, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("limit", [10_000, 7])
def test_corners(spark, limit):
    dice = random.Random(3)
    rows = [(int(dice.random() < s / 200), s / 100) for s in range(100) for _ in range(dice.choice([1, 1, 2]))]
    curve = metrics.roc_curve(spark.createDataFrame(rows, "label int, score double"))
    points = sorted((r["fpr"], r["tpr"]) for r in curve.collect())
    found = sorted((r["fpr"], r["tpr"]) for r in metrics.corners(curve, ScalePolicy(max_group_rows=limit)).collect())
    want = [
        p
        for k, p in enumerate(points)
        if k < 2 or k == len(points) - 1 or any(abs(points[k + 1][c] - 2 * p[c] + points[k - 1][c]) > 1e-12 for c in (0, 1))
    ]
    assert found == want and len(found) < len(points)


def test_a_score_is_no_class(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("label"), (F.col("id") / 7).alias("prediction"))
    with pytest.raises(ValueError, match="prediction"):
        metrics.confusion_matrix(df)


def test_bounded_fit_rows_are_written_once(spark):
    """A fit reads its rows many times: they come from a table of their own, not from the whole input again."""
    rows = spark.range(5000).selectExpr("id AS transaction_id", "cast(id % 5 = 0 AS int) AS label", "cast(id AS double) AS x")
    made = models.fit_rows(rows, 500, id_="transaction_id")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Range" not in plan
    assert 300 < made.count() < 700 and {r[0] for r in made.select("label").distinct().collect()} == {0, 1}
    assert models.fit_rows(rows, 5000).count() == 5000
