import pytest

from swipewatch import ScalePolicy
from swipewatch.operators import metrics, models

# label, prediction, score; two scores tie across the classes
ROWS = [
    (1, 1, 0.95), (0, 0, 0.05), (1, 0, 0.45), (0, 1, 0.65), (1, 1, 0.65), (0, 0, 0.30),
    (0, 0, 0.15), (1, 1, 0.70), (0, 1, 0.55), (0, 0, 0.45), (1, 1, 0.85), (0, 0, 0.25),
]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(ROWS, "label int, prediction int, score double")


def _as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


@pytest.mark.parametrize("policy", [ScalePolicy(), ScalePolicy(max_group_rows=2)])
def test_golden_metrics(scored, policy):
    got = _as_dict(metrics.evaluate(scored, policy=policy))
    assert got == pytest.approx(
        {
            "accuracy": 9 / 12,
            "precision": 4 / 6,
            "recall": 4 / 5,
            "f1_score": 8 / 11,
            "roc_auc": 32 / 35,
            "average_precision": 0.8850000000000001,
        }
    )


def test_report_has_six_named_rows(scored):
    rows = metrics.report(scored)
    assert rows.columns == ["Metric", "Value"]
    assert [r["Metric"] for r in rows.collect()] == list(metrics.REPORT_ROWS)


def test_without_scores(scored):
    assert set(_as_dict(metrics.evaluate(scored.drop("score"), score=None))) == {
        "accuracy",
        "precision",
        "recall",
        "f1_score",
    }
    assert _as_dict(metrics.report(scored.drop("score"), score=None))["ROC AUC"] is None


def test_one_class_and_no_positive_predictions(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.4)], "label int, prediction int, score double")
    got = _as_dict(metrics.evaluate(df))
    assert got["precision"] == got["recall"] == got["f1_score"] == 0.0
    assert got["roc_auc"] is None and got["average_precision"] is None


def test_confusion_matrix(scored, spark):
    cells = {(r[0], r[1]): r[2] for r in metrics.confusion_matrix(scored).collect()}
    assert cells == {(0, 0): 5, (0, 1): 2, (1, 0): 1, (1, 1): 4}
    shares = {(r[0], r[1]): r[2] for r in metrics.confusion_matrix(scored, normalize=True).collect()}
    assert shares == pytest.approx({(0, 0): 5 / 7, (0, 1): 2 / 7, (1, 0): 0.2, (1, 1): 0.8})
    only = spark.createDataFrame([(0, 0)], "label int, prediction int")
    shares = {(r[0], r[1]): r[2] for r in metrics.confusion_matrix(only, normalize=True).collect()}
    assert shares[(1, 0)] == shares[(1, 1)] == 0.0


def test_confusion_matrix_of_any_classes(spark):
    df = spark.createDataFrame([(2, 0), (2, 2), (None, 1), (1, None)], "label int, prediction int")
    cells = {(r[0], r[1]): r[2] for r in metrics.confusion_matrix(df).collect()}
    assert len(cells) == 16 and sum(cells.values()) == 4
    assert cells[(2, 0)] == cells[(2, 2)] == cells[(None, 1)] == cells[(1, None)] == 1


@pytest.mark.parametrize("policy", [ScalePolicy(), ScalePolicy(max_group_rows=3)])
def test_roc_curve_area(scored, policy):
    points = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_curve(scored, policy=policy).collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
    area = sum((b[0] - a[0]) * (b[1] + a[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(32 / 35)


def test_best_model(spark):
    rows = [("a", "recall", 0.9), ("b", "roc_auc", 0.7), ("a", "roc_auc", 0.7), ("c", "roc_auc", 0.6)]
    got = models.best_model(spark.createDataFrame(rows, "model string, metric string, value double"), "roc_auc").first()
    assert got["model"] == "a" and got["value"] == 0.7


def test_class_weights(spark):
    assert models.positive_weight({0: 90, 1: 10}) == 9.0
    assert models.positive_weight({0: 90}) == models.positive_weight({1: 3}) == 1.0
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    weights = {r["label"]: r["weight"] for r in models.balanced(df, {0: 3, 1: 1}).collect()}
    assert weights == pytest.approx({0: 4 / 6, 1: 2.0})
