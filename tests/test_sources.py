import pytest
from pyspark.sql import types as T

from swipewatch.operators import quality
from swipewatch.sources import ingest, retrieval

TWO = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("cents", T.LongType())])


def _file(tmp_path, text, name="data.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_read_csv(spark, tmp_path):
    path = _file(tmp_path, "user_id,cents\n71,1250\n72,99\n71,40000\n")
    for schema in (TWO, None):
        df = ingest.read_csv(spark, path, schema)
        assert df.columns == ["user_id", "cents"] and df.count() == 3


def test_missing_and_empty_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ingest.read_csv(spark, str(tmp_path / "none.csv"), TWO)
    with pytest.raises(ValueError, match="Empty data file"):
        ingest.read_csv(spark, _file(tmp_path, ""), TWO)


def test_bad_rows_fail_or_are_kept(spark, tmp_path):
    path = _file(tmp_path, "user_id,cents\n71,1250\nunknown,99\n73,5,USD\n")
    with pytest.raises(Exception):
        ingest.read_csv(spark, path, TWO).collect()
    good, bad = ingest.quarantine(ingest.read_csv(spark, path, TWO, on_bad_row="keep"))
    assert [tuple(r) for r in good.collect()] == [(71, 1250)] and bad.count() == 2


def test_write_modes(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "t")
    assert ingest.write_table(df, path, "fail")
    with pytest.raises(Exception):
        ingest.write_table(df, path, "fail")
    ingest.write_table(df, path, "append")
    assert spark.read.parquet(path).count() == 6
    ingest.write_table(df, path, "replace")
    assert spark.read.parquet(path).count() == 3
    assert not ingest.write_table(df.filter("id < 0"), path, "replace")
    assert spark.read.parquet(path).count() == 3
    for bad in (lambda: ingest.write_table(df, "", "append"), lambda: ingest.write_table(df, path, "merge")):
        with pytest.raises(ValueError):
            bad()


CONFIG = {"user": "u", "password": "p@ss", "host": "db", "port": 5432, "database": "fraud"}


def test_jdbc_options():
    options = ingest.jdbc_options(CONFIG, "transactions", ("transaction_id", 1, 100, 4))
    assert options["url"] == "jdbc:postgresql://db:5432/fraud"
    assert "p@ss" not in options["url"] and options["password"] == "p@ss"
    assert options["numPartitions"] == "4" and options["partitionColumn"] == "transaction_id"
    with pytest.raises(ValueError):
        ingest.jdbc_options({**CONFIG, "database": "fraud?user=root"}, "t")
    with pytest.raises(KeyError):
        ingest.jdbc_options({"user": "u"}, "t")


def test_bound_values_are_not_sql(spark, four_rows):
    assert retrieval.transactions_between(four_rows.withColumn("transaction_date", four_rows.transaction_date.cast("timestamp")),
                                          "2024-01-01 00:10:00", "2024-01-01 00:30:00").count() == 2
    users = spark.createDataFrame([(1, "a", "a@x", None, None)], "user_id long, user_name string, email string, phone string, created_at timestamp")
    assert retrieval.find_users(users, email="a@x").count() == 1
    assert retrieval.find_users(users, email="' OR '1'='1").count() == 0
    assert "fraud" not in retrieval.fraud_transactions(four_rows).columns


def test_date_range_reaches_the_scan(spark, tmp_path, four_rows):
    path = str(tmp_path / "t")
    four_rows.withColumn("transaction_date", four_rows.transaction_date.cast("timestamp")).write.parquet(path)
    df = retrieval.transactions_between(spark.read.parquet(path), "2024-01-01", "2024-01-02")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(transaction_date" in plan.split("PushedFilters")[1]


def test_merge_append_twice_is_once(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "transaction_id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (None, "n"), (None, "m")], "transaction_id long, v string")
    once = quality.merge_append(stored, new, version=("v",))
    twice = quality.merge_append(once, new, version=("v",))
    expected = [(1, "a"), (2, "c"), (3, "d"), (None, "m"), (None, "n")]
    for df in (once, twice):
        assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(expected, key=str)


def test_latest_per_key(spark):
    rows = [(1, 3, "x"), (1, 5, "y"), (1, 4, "z"), (None, 1, "p"), (None, 2, "q"), (2, 1, "b"), (2, 1, "a")]
    df = spark.createDataFrame(rows, "k long, version int, v string")
    for parts in (1, 5):
        got = {(r["k"], r["v"]) for r in quality.latest_per_key(df.repartition(parts), "k", "version").collect()}
        assert got == {(1, "y"), (2, "b"), (None, "p"), (None, "q")}


def test_ingest_by_key_is_repeatable(spark, tmp_path):
    head = "transaction_id,user_id,merchant_id,transaction_date,amount,currency,status,fraud\n"
    first = head + "1,7,9,2024-01-01 10:00:00,5.0,USD,approved,0\n2,7,9,2024-01-02 10:00:00,6.0,USD,approved,0\n"
    second = head + "2,7,9,2024-01-03 10:00:00,8.0,USD,approved,0\n3,8,9,2024-01-03 11:00:00,7.0,EUR,approved,1\n"
    for by_day in (False, True):
        table = str(tmp_path / f"t{by_day}")
        for n, text in enumerate((first, second, second)):
            path = _file(tmp_path, text, f"{by_day}{n}.csv")
            assert ingest.ingest(spark, path, table, partition_by_day=by_day, key="transaction_id")
        found = {r["transaction_id"]: r["amount"] for r in spark.read.parquet(table).collect()}
        assert spark.read.parquet(table).count() == 3 and found == {1: 5.0, 2: 8.0, 3: 7.0}


def test_shared_folder_is_never_one_machine_of_a_cluster():
    from types import SimpleNamespace

    from swipewatch.sources.paths import shared_folder

    def session(master, named=None, context=None):
        made = []
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default=None: named),
            sparkContext=SimpleNamespace(
                master=master, getCheckpointDir=lambda: made[-1] if made else context, setCheckpointDir=made.append
            ),
        )

    assert shared_folder(session("spark://x:7077", "hdfs://n/tmp/")) == "hdfs://n/tmp"
    assert shared_folder(session("spark://x:7077", None, "hdfs://n/c")) == "hdfs://n/c"
    assert "swipewatch-" in shared_folder(session("local[4]"))
    for master in ("spark://x:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
