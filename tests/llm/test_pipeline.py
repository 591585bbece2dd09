"""The pipeline: each stage against its operator on what the predecessor kept."""

import pytest

import corpus_pipeline
from swipewatch.llm import decontaminate, exact_dedup, quality, simhash
from swipewatch.llm.shared import stored

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_keep_columns_and_shrink(kept):
    for before, after in zip(kept, kept[1:]):
        assert after.columns == kept[0].columns
        assert ids(after) <= ids(before)
    assert ids(kept[2]) < ids(kept[1]) < ids(kept[0])


def test_decisions_take_effect(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(kept[1]) == ids(quality.scored(kept[0], labels).where("predicted = 1"))
    assert ids(kept[2]) == ids(exact_dedup.exact_groups(kept[1]).where("kept"))
    assert ids(kept[3]) == ids(simhash.near_groups(kept[2]).where("doc_id = component_id"))
    assert ids(kept[4]) == ids(decontaminate.contamination(kept[3], items).where("NOT contaminated"))


def test_clean_documents_stay(spark, kept):
    """Well labelled documents that are no copies and hold no benchmark passage are all there at the end."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = ids(labels.where("quality = 1")) & ids(kept[0])
    single = ids(simhash.near_groups(kept[0]).groupBy("component_id").count().where("count = 1").withColumnRenamed("component_id", "doc_id"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = good & single & ids(decontaminate.contamination(kept[0], items).where("NOT contaminated"))
    assert len(clean & ids(kept[4])) >= 0.99 * len(clean)


def test_run_packs_what_is_left(spark, kept):
    rows = corpus_pipeline.run(spark, SF)
    assert ids(rows) == ids(kept[4])
