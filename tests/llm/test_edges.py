"""Every operator takes nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from swipewatch.llm import (
    decontaminate,
    exact_dedup,
    language,
    language_model,
    license,
    packing,
    pii,
    quality,
    simhash,
    warc,
)

LONG = " ".join(f"word{k % 977}" for k in range(60_000)) + " Licensed under CC BY-NC 4.0."
ROWS = [
    (1, "the first text, quite plain.", "a"),
    (1, "the first text, quite plain.", "a"),
    (2, "the  first\ttext, quite plain.", None),
    (None, "no id but words", "b"),
    (None, None, None),
    (3, None, "c"),
    (4, "", "c"),
    (5, " \n\t ", "c"),
    (6, LONG, "d"),
    (7, "Mail a.b@c.example or call +1 (017) 555-7713 now", "d"),
    (8, "é ñ ß 汉字 \U0001f600 x", "e"),
    (9, "x" * 50_000, "e"),
]
# names that operators might use themselves
CLASHING = ("print", "sha", "n", "mark", "row", "id", "role", "routed", "gone_id", "gone_sha", "gone_mark", "x", "label", "text_")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, None), (3, None, 1), (None, 1, 1), (9, 0, 0), (7, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "first text"), (1, "first text"), (2, None), (None, "word0"), (3, ""), (4, "not to be found anywhere")]
    return spark.createDataFrame(rows, "item_id long, text string")


def as_pages(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), *CLASHING)


def operators(labels, items):
    return {
        "language": lambda d: language.identified(as_pages(d), d),
        "license": license.scanned,
        "decontaminate": lambda d: decontaminate.contamination(d, items),
        "pii": pii.all_spans,
        "exact_dedup": exact_dedup.exact_groups,
        "warc": lambda d: warc.capture_histories(as_pages(d)),
        "simhash": simhash.near_groups,
        "quality": lambda d: quality.scored(d, labels),
        "packing": packing.packed,
        "language_model": lambda d: language_model.scored(d, language_model.held_out_by_id()),
    }


NAMES = sorted(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, labels, items, name):
    rows = operators(labels, items)[name](docs).collect()
    if name == "packing":
        assert sum(r["start"] == 0 for r in rows) == len(ROWS)
    else:
        assert len(rows) == len(ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(none, labels, items, name):
    made = operators(labels, items)[name](none)
    assert made.collect() == []
    assert made.columns


@pytest.mark.parametrize("name", ["exact_dedup", "simhash", "decontaminate", "quality"])
def test_filters_keep_columns(docs, none, labels, items, name):
    keep = {
        "exact_dedup": exact_dedup.drop_copies,
        "simhash": simhash.drop_near_copies,
        "decontaminate": lambda d: decontaminate.drop_contaminated(d, items),
        "quality": lambda d: quality.keep_good(d, labels),
    }[name]
    assert keep(docs).columns == docs.columns
    assert keep(none).collect() == []
    kept = [r["doc_id"] for r in keep(docs).collect()]
    if name == "exact_dedup":
        assert sorted(kept, key=str) == sorted([1, None, 3, 5, 6, 7, 8, 9], key=str)  # 3, 4 and one without id are empty
    if name == "decontaminate":
        assert sorted(kept, key=str) == sorted([None, None, 3, 4, 5, 7, 8, 9], key=str)


def test_no_items(docs, items):
    rows = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(rows) == len(ROWS) and not any(r["contaminated"] for r in rows)


def test_no_labels(docs, labels):
    scores = {r["score"] for r in quality.scored(docs, labels.limit(0)).collect()}
    assert scores == {0.5}
