"""A stream of scores joined with late labels equals the batch join, row by row, also when it is stopped between batches."""

import datetime as dt

from pyspark.sql import functions as F

from swipewatch.sources.paths import fresh_path
from swipewatch.streaming.jobs import labelled_stream, read_stream

START = dt.datetime(2024, 1, 1)
SCORES = "transaction_id long, transaction_date timestamp, score double, prediction int"
LABELS = "transaction_id long, label int, labelled_at timestamp"


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_late_labels(spark):
    root = fresh_path(spark, "late_labels")
    # id: hours until its label, None if it never gets one
    waits = {1: 1, 2: 30, 3: None, 4: 24 * 7, 5: 24 * 8, 6: -1, 7: 0, 8: None}
    folders = [f"{root}/scores", f"{root}/labels"]

    def arrive(scores, labels):
        spark.createDataFrame(scores, SCORES).coalesce(1).write.mode("append").parquet(folders[0])
        spark.createDataFrame(labels, LABELS).coalesce(1).write.mode("append").parquet(folders[1])

    def run():
        s, m = (read_stream(spark, f, spark.read.parquet(f).schema) for f in folders)
        labelled_stream(s, m, f"{root}/out", f"{root}/checkpoint").awaitTermination()

    def rows():
        return sorted((r["transaction_id"], r["label"]) for r in spark.read.parquet(f"{root}/out").collect())

    arrive([(k, at(k), 0.5, 1) for k in waits], [(k, k % 2, at(k + w)) for k, w in waits.items() if w is not None and w < 24])
    run()
    assert rows() == [(1, 1), (7, 1)]
    # the labels of days later come with rows of that time
    arrive([(100, at(24 * 6), 0.5, 1)], [(k, k % 2, at(k + w)) for k, w in waits.items() if w is not None and w >= 24])
    run()
    assert rows() == [(1, 1), (2, 0), (4, 0), (7, 1)]
    # both streams pass the limit: what has no label comes out without one, once
    arrive([(101, at(24 * 30), 0.5, 1)], [(101, 1, at(24 * 30))])
    run()
    run()
    assert rows() == [(1, 1), (2, 0), (3, None), (4, 0), (5, None), (6, None), (7, 1), (8, None), (100, None), (101, 1)]
    assert spark.read.parquet(f"{root}/out").where(F.col("score") != 0.5).count() == 0
