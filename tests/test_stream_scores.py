"""What stream_scores says of its scores, and what the queries with a fitted model say besides."""

from catalog.queries import _judged


def test_judged_with_and_without_learned(spark):
    rows = spark.createDataFrame([(1, 0, 0.2, 0), (2, 1, 0.9, 1)], "transaction_id long, label int, score double, prediction int")
    plain = _judged(rows)
    assert plain.columns == ["transaction_id", "label", "is_chance", "follows"]
    assert [tuple(r) for r in plain.orderBy("transaction_id").collect()] == [(1, 0, True, True), (2, 1, True, True)]
    assert _judged(rows, False).columns[-1] == "learned"
