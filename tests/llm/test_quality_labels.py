"""Without labels of both classes nothing is rejected."""

import pytest

from swipewatch.llm import quality


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(1, 0), (2, 0), (3, 0)], [(1, None)]])
def test_fewer_than_two_classes_reject_nothing(spark, marks):
    docs = spark.createDataFrame([(k, f"text number {k} with some words") for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    assert quality.keep_good(docs, labels).count() == 20
