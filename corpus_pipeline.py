"""A pipeline from raw documents to packed training sequences: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``documents``. Between stages the rows are written as Parquet and read again,
so that a lost executor costs no more than the running stage.
"""

from __future__ import annotations

from swipewatch.llm import decontaminate, exact_dedup, packing, quality, simhash
from swipewatch.llm.shared import stored


def good_quality(spark, docs, sf_dir):
    """Rejected documents go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark, docs, sf_dir):
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark, docs, sf_dir):
    """Of each group of near copies the one with the smallest id stays."""
    return simhash.drop_near_copies(docs)


def without_benchmarks(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def into_sequences(spark, docs, sf_dir):
    """Pieces of documents with their sequence and place there."""
    return packing.packed(docs)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmarks),
    ("packing", into_sequences),
]

# Fingerprints, components, a fitted model and a tokenizer are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
