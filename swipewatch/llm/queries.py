"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from swipewatch.llm import (
    alignment,
    decontaminate,
    exact_dedup,
    language,
    language_model,
    license,
    mining,
    packing,
    pii,
    quality,
    simhash,
    substrings,
    warc,
)

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_language(spark, folder):
    return language.identified(table(spark, folder, "pages"), table(spark, folder, "documents"))


@query
def op2_license(spark, folder):
    found = license.scanned(table(spark, folder, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.col("found.license"))), ",")
    spans = F.array_join(
        F.transform("found", lambda f: F.concat_ws(":", f["license"], f["first"].cast("string"), f["end"].cast("string"))), ","
    )
    best = F.coalesce(F.array_max(F.col("found.coverage")), F.lit(0.0))
    return found.select(
        "doc_id", F.size("found").cast("long").alias("n_found"), names.alias("licenses"), best.alias("coverage"), spans.alias("spans")
    )


@query
def op3_decontaminate(spark, folder):
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query
def op4_pii(spark, folder):
    found = pii.all_spans(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of_base = F.transform(base, lambda s: s["kind"])
    counts = [
        (F.size(of_base) - F.size(F.array_remove(of_base, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS
    ]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query
def op5_exact_dedup(spark, folder):
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query
def op6_warc(spark, folder):
    # pages have no time of capture; one second per id stands for it
    time = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id"))
    found = warc.capture_histories(table(spark, folder, "pages"), time=time)
    return found.select(
        F.col("page").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers").alias("refers_to"),
    )


@query
def op7_simhash(spark, folder):
    return simhash.near_groups(table(spark, folder, "documents"))


@query
def op8_quality(spark, folder):
    return quality.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_packing(spark, folder):
    return packing.packed(table(spark, folder, "documents"))


@query
def op10_language_model(spark, folder):
    return language_model.scored(table(spark, folder, "documents"), language_model.held_out_by_id())


@query
def op11_hard_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.mined(table(spark, folder, "embeddings"), label=label, anchor=F.col("id") % 100 == 0)


@query
def op13_alignment(spark, folder):
    return alignment.aligned(table(spark, folder, "documents"))


@query
def op12_substrings(spark, folder):
    return substrings.without_repeats(table(spark, folder, "documents"), with_text=False)
