import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from swipewatch import TxnConfig, jobs
from swipewatch.operators import encode, models, split
from swipewatch.sources import demo, stored
from swipewatch.sources.paths import fresh_path
from swipewatch.streaming import jobs as streaming

SMALL = {"random_forest": {"n_estimators": 5}, "boosted_trees": {"n_estimators": 3, "max_depth": 3}}


def test_preprocess_without_time(spark):
    rows = [(n, "ABC"[(n - 1) % 3], n % 2) for n in range(1, 11)]
    df = spark.createDataFrame(rows, "numeric_feature long, categorical_feature string, fraud int")
    done = jobs.preprocess(df)
    train, test = done.train.collect(), done.test.collect()
    assert (len(train), len(test)) == (8, 2)
    assert {len(r["features"]) for r in train + test} == {len(done.names)}
    assert {r["label"] for r in train + test} == {0, 1}
    assert not done.settings["time_based_split"]


def test_preprocess_rejects_a_missing_label(four_rows):
    with pytest.raises(ValueError):
        jobs.preprocess(four_rows.drop("fraud"))


def test_encoder_goldens(spark):
    train = spark.createDataFrame([(1.0, "b"), (3.0, None), (None, "a"), (8.0, "b")], "x double, c string")
    test = spark.createDataFrame([(None, "z"), (2.0, None)], "x double, c string")
    model, names = encode.fit_encoder(train, ["x", "c"])
    assert names == ["num__x", "num__missingindicator_x", "cat__c_a", "cat__c_b"]
    sd = ((1 - 3.75) ** 2 + 2 * (3 - 3.75) ** 2 + (8 - 3.75) ** 2) ** 0.5 / 2
    flag = 0.1875**0.5
    got = [r[0] for r in model.transform(test).select(vector_to_array("features")).collect()]
    assert got[0] == pytest.approx([3 / sd, 1 / flag, 0, 0])
    assert got[1] == pytest.approx([2 / sd, 0, 0, 1])


def test_encoder_edge_columns(spark):
    train = spark.createDataFrame([(5.0, None, True, "it's"), (5.0, None, False, "it's")], "k double, e double, b boolean, q string")
    model, names = encode.fit_encoder(train, ["k", "e", "b", "q"])
    assert "num__e" not in names and "cat__q_it's" in names
    first = model.transform(train).select(vector_to_array("features")).first()[0]
    assert dict(zip(names, first))["num__k"] == 5.0  # no spread: divided by one
    with pytest.raises(ValueError):
        encode.fit_encoder(train, [])


def test_most_frequent_takes_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string")
    assert encode.most_frequent(df, ["c"]) == {"c": "a"}


def test_labels(spark):
    df = spark.createDataFrame([("no",), ("yes",), ("no",)], "label string")
    assert [r["label"] for r in encode.label_as_int(df, "label").collect()] == [0, 1, 0]


def test_csv_to_report(spark, folder, tmp_path):
    root = fresh_path(spark, "whole")
    csv = fresh_path(spark, "csv")
    jobs.save_snapshot(demo.transactions_with_gaps(spark, folder), csv)
    assert jobs.run_ingestion(spark, csv, f"{root}/table", f"{root}/snapshot")
    done = jobs.run_preprocess(spark, f"{root}/table", f"{root}/prepared", cfg=TxnConfig(windows=("24h",)))
    n = demo.transactions(spark, folder).count()
    assert done.train.count() == int(n * 0.8)
    settings = stored.read_metadata(spark, f"{root}/prepared/settings")
    assert settings["time_based_split"] and settings["feature_names"] == done.names
    assert all("user_id" not in x and "transaction_date" not in x for x in done.names)
    metrics = jobs.run_training(spark, f"{root}/prepared/train", f"{root}/prepared/test", f"{root}/models", params=SMALL)
    found = {(r["model"], r["metric"]): r["value"] for r in metrics.collect()}
    assert len(found) == 12 and all(0 <= v <= 1 for v in found.values())
    report = jobs.run_evaluation(
        spark, f"{root}/models/random_forest", f"{root}/prepared/test", f"{root}/report", f"{root}/matrix"
    )
    shown = {r["Metric"]: r["Value"] for r in report.collect()}
    assert shown["ROC AUC"] == pytest.approx(found[("random_forest", "roc_auc")])
    assert spark.read.option("header", True).csv(f"{root}/report").count() == 6
    assert spark.read.option("header", True).csv(f"{root}/matrix").count() == 4
    with pytest.raises(ValueError):
        jobs.train_models(done.train, done.test, "svm")


def test_training_without_test_set_holds_rows_out(spark, folder):
    t = demo.transactions(spark, folder)
    model, _ = encode.fit_encoder(t, ["amount", "status"])
    rows = model.transform(t).select("transaction_id", "features", F.col("fraud").alias("label"))
    trained = jobs.train_models(rows, None, "rf", SMALL)
    assert trained["random_forest"][1].count() == 200


def test_stored_artefacts(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        stored.load_model(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        stored.read_features(spark, str(tmp_path / "none"))
    spark.range(3).write.parquet(str(tmp_path / "ids"))
    with pytest.raises(ValueError):
        stored.read_features(spark, str(tmp_path / "ids"))


def test_importance_and_search(spark, folder):
    t = demo.transactions(spark, folder)
    model, names = encode.fit_encoder(t, ["amount", "merchant_id", "status"])
    rows = model.transform(t).select("features", F.col("fraud").alias("label"), split.time_fold(t, 2).alias("fold"))
    assert {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()} == {0: 500, 1: 500}
    best, found = models.search(rows, models.class_counts(rows), {"maxDepth": [1, 3]}, params={"numTrees": 3}, folds=2)
    assert found.count() == 2
    listed = models.feature_importance(best, names).collect()
    values = [r["importance"] for r in listed]
    assert len(values) == len(names) and values == sorted(values, reverse=True)


def test_late_rows_go_to_the_side_table(spark, four_rows):
    t = four_rows.withColumn("transaction_date", F.col("transaction_date").cast("timestamp"))
    run = streaming.FeatureStream(spark, fresh_path(spark, "features"), TxnConfig(windows=("1h",)), late="1h")
    run.process(t.filter("transaction_id IN (1, 3)"), 0)
    assert [r["transaction_id"] for r in run.features().collect()] == [1]  # row 3 is held back
    run.process(t.filter("transaction_id IN (2, 4)"), 1)  # both more than 1h before row 3
    run.process(t.filter("transaction_id IN (2, 4)"), 1)  # the same batch again
    run.finish()
    assert [r["transaction_id"] for r in run.features().orderBy("transaction_id").collect()] == [1, 3]
    late = spark.read.parquet(f"{run.path}/late/batch=1")
    assert late.count() == 2


def test_stream_looks_back_over_older_days(spark):
    rows = [(n, 1, 5, f"2024-01-{n:02d} 12:00:00", float(n * n), "USD", "approved", 0) for n in range(1, 11)]
    t = spark.createDataFrame(
        rows, "transaction_id long, user_id long, merchant_id long, transaction_date string, amount double,"
        " currency string, status string, fraud int"
    ).withColumn("transaction_date", F.col("transaction_date").cast("timestamp"))
    cfg = TxnConfig(windows=("24h",))
    run = streaming.FeatureStream(spark, fresh_path(spark, "features"), cfg)
    for n, (low, high) in enumerate([(1, 3), (4, 7), (8, 10)]):
        run.process(t.filter(F.col("transaction_id").between(low, high)), n)
    run.finish()
    from swipewatch.operators.features import add_features

    batch = {r["transaction_id"]: r for r in add_features(t, cfg, ("user", "merchant")).collect()}
    got = run.features().collect()
    assert len(got) == 10
    for r in got:
        for c in ("user_amount_zscore", "user_time_since_last_txn", "user_amount_sum_24h", "merchant_fraud_rate_24h"):
            expected = batch[r["transaction_id"]][c]
            assert r[c] == (pytest.approx(expected) if expected is not None else None)


def test_stream_state_does_not_grow(spark):
    """What is kept depends on the look-back, not on how long the stream has run."""
    from pathlib import Path

    schema = "transaction_id long, user_id long, merchant_id long, transaction_date timestamp, amount double, fraud int"
    run = streaming.FeatureStream(spark, fresh_path(spark, "features"), TxnConfig(windows=("24h",)), late="1h")
    kept = []
    for n in range(12):
        rows = [(10 * n + k, k, 1, None, float(n + k), 0) for k in range(3)]
        day = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=F.lit(n))
        run.process(spark.createDataFrame(rows, schema).withColumn("transaction_date", day), n)
        root = Path(run.path.removeprefix("file:"))
        kept.append(sum(len(list(root.glob(f"{t}/*"))) for t in ("rows", "summaries", "history", "pending", "progress", "arrived")))
    assert kept[-1] <= kept[5]
    run.finish()
    last = {r["transaction_id"]: r for r in run.features().collect()}
    assert len(last) == 36 and last[110]["user_time_since_last_txn"] == 86400
    assert last[110]["user_amount_zscore"] == pytest.approx((11 - 5) / (sum((x - 5) ** 2 for x in range(11)) / 10) ** 0.5)


def test_text_labels_are_learned_on_training_rows(spark):
    df = spark.createDataFrame([("no",), ("yes",), ("no",), (None,)], "label string")
    classes = encode.label_classes(df, "label")
    assert classes == ["no", "yes"] and encode.label_classes(spark.range(2), "id") is None
    assert [r["label"] for r in encode.apply_classes(df, "label", classes).collect()] == [0, 1, 0, None]
    with pytest.raises(Exception, match="unseen class"):
        encode.apply_classes(df, "label", ["no"]).collect()


def test_infinite_values_are_described(spark):
    from swipewatch.operators import profile

    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("inf"),), (None,)], "x double")
    assert profile.describe(df).first()["q75"] == float("inf")
    assert profile.box_stats(df).count() == 1
    assert sum(r["n"] for r in profile.histogram(df, "x", 4).collect()) == 3


def test_a_rare_class_keeps_a_row(spark):
    from swipewatch.operators.models import fit_rows

    df = spark.range(20_000).selectExpr("id AS transaction_id", "IF(id = 7, 1, 0) AS label")
    found = {r["label"]: r["count"] for r in fit_rows(df, 500, id_="transaction_id").groupBy("label").count().collect()}
    assert found[1] == 1 and 400 < found[0] < 600
