"""Features of new rows from stored history equal those of the whole table."""

import pytest
from conftest import TXN_SCHEMA
from pyspark.sql import functions as F

from swipewatch import ScalePolicy, TxnConfig
from swipewatch.operators.features import add_features, feature_names
from swipewatch.sources import demo
from swipewatch.sources.history import StoredHistory, features_from_history
from swipewatch.sources.paths import fresh_path


def same(left, right, columns):
    a = {r["transaction_id"]: r for r in left.collect()}
    b = {r["transaction_id"]: r for r in right.collect()}
    assert a.keys() == b.keys() and a
    for k, row in a.items():
        for c in columns:
            x, y = row[c], b[k][c]
            assert x == (pytest.approx(y, rel=1e-9, abs=1e-9) if isinstance(y, float) else y), (k, c)


@pytest.mark.parametrize(
    ("cfg", "limit"), [(TxnConfig(), 60), (TxnConfig(windows=("90min", "3d"), label_delay="36h"), 1_000_000)]
)
def test_new_rows_alone_equal_the_whole_table(spark, folder, cfg, limit):
    t = demo.transactions_with_gaps(spark, folder)
    cut = F.expr(f"timestamp'{t.agg(F.max('transaction_date') - F.expr('INTERVAL 9 DAYS')).first()[0]}'")
    stored = StoredHistory(spark, fresh_path(spark, "history"), cfg)
    old, new = t.where(F.col("transaction_date") < cut), t.where(F.col("transaction_date") >= cut)
    policy = ScalePolicy(max_group_rows=limit)
    # two batches, one of them written again
    for batch, part in (("a", "transaction_id % 2 = 0"), ("b", "transaction_id % 2 = 1"), ("a", "transaction_id % 2 = 0")):
        stored.append(old.where(part), batch)
    want = add_features(t, cfg, policy=policy).where(F.col("transaction_date") >= cut)
    got = features_from_history(new, stored, policy=policy)
    assert got.columns == want.columns
    same(got, want, feature_names(t.columns, cfg))


def test_rows_in_the_middle_of_history_see_only_what_is_before(spark):
    rows = [(n, 1, 7, f"2024-01-{1 + n // 4:02d} {6 * (n % 4):02d}:00:00", float(n), "USD", "approved", n % 2) for n in range(24)]
    t = spark.createDataFrame(rows, TXN_SCHEMA)
    stored = StoredHistory(spark, fresh_path(spark, "history"))
    stored.append(t.where("transaction_id NOT IN (9, 10)"))
    want = add_features(t).where("transaction_id IN (9, 10)")
    same(features_from_history(t.where("transaction_id IN (9, 10)"), stored), want, feature_names(t.columns, TxnConfig()))


def test_odd_rows_and_no_history(spark):
    rows = [
        (1, None, 7, "2024-01-01 00:00:00", 1.0, "USD", "approved", 0),
        (2, 5, None, "2024-01-01 00:10:00", None, None, "approved", None),
        (3, 5, 7, None, 3.0, "USD", None, 1),
        (4, 5, 7, "2024-01-01 00:10:00", 4.0, "USD", "approved", 1),
        (5, 5, 7, "1969-12-31 23:50:00", 4.0, "USD", "approved", 1),
        (6, 5, 7, "2024-01-01 00:30:00", float("nan"), "USD", "approved", 1),
    ]
    t = spark.createDataFrame(rows, TXN_SCHEMA)
    stored = StoredHistory(spark, fresh_path(spark, "nothing"))
    same(features_from_history(t, stored), add_features(t), feature_names(t.columns, TxnConfig()))
    stored.append(t.limit(0))
    assert features_from_history(t.limit(0), stored).count() == 0


def test_only_the_days_of_the_edges_are_read(spark, folder):
    t = demo.transactions(spark, folder)
    stored = StoredHistory(spark, fresh_path(spark, "history"))
    stored.append(t)
    day = t.agg(F.max(F.unix_date(F.to_date("transaction_date")))).first()[0]
    plan = stored.rows([day, day - 1])
    assert {r["day"] for r in plan.select("day").distinct().collect()} <= {day, day - 1}
    assert all(f"day={day}" in f or f"day={day - 1}" in f for f in plan.inputFiles())


def test_no_side_that_goes_by_the_input_is_broadcast(spark, tmp_path):
    """Small as these tables are, keys and instants meet by sort-merge joins: together they may not fit the driver."""
    rows = spark.range(300).selectExpr(
        "id AS transaction_id", "id % 7 AS user_id", "id % 3 AS merchant_id",
        "timestamp_micros(1704067200000000 + id * 3600000000) AS transaction_date", "cast(id AS double) AS amount",
        "'USD' AS currency", "'approved' AS status", "cast(id % 2 AS int) AS fraud",
    )
    stored = StoredHistory(spark, str(tmp_path / "history"))
    stored.append(rows.where("transaction_id < 200"))
    made = features_from_history(rows.where("transaction_id >= 200"), stored)
    assert made.count() == 100
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
