"""Base spans against the plain patterns, the method's own spans, redaction, and the plan."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from swipewatch.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(x) <= 255 for x in hit.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def plain(text):
    spans = [
        (m.start(), no, m.end(), kind)
        for no, kind in enumerate(pii.KINDS)
        for m in re.finditer(PLAIN[kind], text or "", re.ASCII)
        if holds(kind, m.group())
    ]
    return sorted(spans)


def base_of(rows):
    return {r["doc_id"]: [(s["start"], s["no"], s["end"], s["kind"]) for s in r["spans"] if s["base"]] for r in rows}


ALPHABET = ["a", "Z", "0", "1", "25", "255", "256", ".", "@", "-", "+", "_", " ", "(", ")", "é", "\U0001f600", "4111 1111 1111 1111", "+1 (017) 555-7713", "x@y.z", "10.0.0.1", "\n"]


def test_base_spans_of_random_texts(spark):
    dice = random.Random(11)
    texts = [(k, "".join(dice.choice(ALPHABET) for _ in range(dice.randint(0, 60)))) for k in range(1500)]
    texts += [(9001, "a@b.c_d@e.f"), (9002, "1.2.3.4.5.6.7.8"), (9003, "@" * 50 + "a@b"), (9004, "0001.02.3.00255"), (9005, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert base_of(pii.all_spans(docs).collect()) == {d: plain(t) for d, t in texts}


def test_documents(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries.op4_pii(spark, folder).collect()
    assert len(found) == len(docs)
    for r in found:
        want = plain(docs[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[3] == k for s in want) for k in pii.KINDS]
        assert set(text.split(",")) - {""} <= set(r["spans"].split(","))


def test_long_runs_take_linear_time(spark):
    texts = [(1, "a" * 300_000), (2, "1" * 300_000), (3, "1-" * 150_000), (4, "999." * 75_000), (5, "+" * 100_000 + "1" + "(" * 100_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert all(not r["spans"] for r in pii.all_spans(docs).collect())


@pytest.fixture(scope="module")
def taught(spark):
    """Prefixed numbers teach what a number looks like; the same form without prefix is proposed by the wide generator."""
    dice, rows = random.Random(2), []
    for k in range(900):
        number = f"({dice.randint(200, 999)}) {dice.randint(200, 999)}-{dice.randint(1000, 9999)}"
        if k % 3 == 0:
            rows.append((k, f"please call +1 {number} today"))
        elif k % 3 == 1:
            rows.append((k, f"order {dice.randint(10**9, 10**10 - 1)} was sent"))
        else:
            rows.append((k, "nothing to see in version 3.10 of 2024"))
    rows.append((5000, "please call (212) 555-0187 today"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_method_adds_spans(taught):
    rows = {r["doc_id"]: r for r in pii.all_spans(taught).collect()}
    assert [(s["kind"], s["start"], s["end"], s["base"]) for s in rows[5000]["spans"]] == [("phone", 12, 26, False)]
    assert all(not r["spans"] for d, r in rows.items() if d % 3 != 0 and d != 5000)
    assert all(len(r["spans"]) == 1 for d, r in rows.items() if d % 3 == 0)


def test_redaction(taught):
    texts = taught.where("doc_id IN (0, 1, 5000)")
    both = pii.all_spans(taught).join(texts, "doc_id")
    out = {r["doc_id"]: r["t"] for r in both.select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert out[0] == "please call [phone] today" and out[5000] == "please call [phone] today"
    assert out[1].startswith("order ") and out[1].endswith(" was sent")


def test_no_python_in_the_plan(spark, folder):
    plan = queries.op4_pii(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
