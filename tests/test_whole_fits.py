"""The model queries fit on all training rows, not on some of them."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from catalog import queries as catalogue
from swipewatch.operators import models, trees
from swipewatch.sources.paths import fresh_path

ROWS = 3000  # more than what fits were once bounded by, in the training part too
SMALL = {"random_forest": {"n_estimators": 4, "max_depth": 4}, "boosted_trees": {"n_estimators": 3, "max_depth": 3}}


@pytest.fixture(scope="module")
def table(spark):
    folder = fresh_path(spark, "whole_fits")
    kind = F.when(F.col("id") % 5 == 0, "error").when(F.col("id") % 7 == 0, "signup").otherwise("view")
    spark.range(ROWS).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 40).alias("user_id"),
        kind.alias("event_type"),
        ((F.col("id") * 37) % 130).cast("double").alias("value"),
        F.concat(F.lit('{"k": '), F.col("id") % 9, F.lit("}")).alias("props"),
    ).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.fixture
def fitted(monkeypatch):
    """Rows that each trainer was given; Spark's ensembles are small, the others as the queries have them."""
    seen = {}

    def spy(name, fit, params=None):
        def run(df, *args, **kw):
            seen[name] = df.count()
            return fit(df, args[0], params) if params else fit(df, *args, **kw)

        return run

    for name, fit in list(models.TRAINERS.items()):
        monkeypatch.setitem(models.TRAINERS, name, spy(name, fit, SMALL[name]))
    for name in ("boosted", "balanced_forest"):
        monkeypatch.setattr(trees, name, spy(name, getattr(trees, name)))
    for _, made in catalogue._FITTED.values():
        made.clear()
    yield seen
    for _, made in catalogue._FITTED.values():
        made.clear()


@pytest.mark.parametrize(
    "name, fits",
    [
        ("balanced_forest_scores", ["balanced_forest", "random_forest"]),
        ("gbt_scores", ["boosted_trees"]),
        ("hist_boosting_scores", ["boosted", "random_forest"]),
        ("rf_scores", ["random_forest"]),
        ("score_new_table", ["random_forest"]),
        ("training_metrics", ["boosted_trees", "random_forest"]),
    ],
)
def test_fits_on_all_training_rows(spark, table, fitted, name, fits):
    out = catalogue.QUERIES[name](spark, table)
    assert out.count() == {"score_new_table": ROWS, "training_metrics": 12}.get(name, ROWS // 5)
    assert fitted == {k: ROWS * 4 // 5 for k in fits}


def test_a_forest_of_several_fits_is_one_model(spark):
    slots = "array(cast(id % 7 AS double), cast(id % 31 AS double), cast(id % 11 AS double), cast(id % 13 AS double))"
    df = spark.range(400).selectExpr(f"{slots} AS x", "cast(pmod(xxhash64(id), 10) < id % 7 AS int) AS label")
    df = df.select("label", array_to_vector("x").alias("features"))
    n = 2 * models.TREES_AT_ONCE + 1
    model = models.train_forest(df, models.class_counts(df), {"n_estimators": n, "max_depth": 3})
    assert model.getNumTrees == len(model.trees) == n and model.getMaxDepth() == 3
    # each fit draws rows and features of its own
    assert len({t.toDebugString.split("\n", 1)[1] for t in model.trees}) > n // 2
    path = fresh_path(spark, "forest")
    model.write().overwrite().save(path)
    again = type(model).load(path)
    said = [(r["label"], r["score"]) for r in models.score(model, df).collect()]
    assert said == [(r["label"], r["score"]) for r in models.score(again, df).collect()]
    one, no = ([s for y, s in said if y == label] for label in (1, 0))
    assert sum(one) / len(one) > sum(no) / len(no) + 0.1
