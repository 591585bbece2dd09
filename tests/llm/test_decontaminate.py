"""Decontamination against a plain search, and the form of its plan."""

import hashlib
import re

import pytest

from swipewatch.llm import decontaminate, queries

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    wanted = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            wanted.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    sizes = {len(k) for k in wanted}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                got = wanted.get(tuple(w[s : s + n]))
                if got:
                    hit |= set(range(s, s + n))
                    found |= got
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), digest, bool(hit))
    return out


def test_whole_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()
    found = {
        r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
        for r in queries.op3_decontaminate(spark, folder).collect()
    }
    want = plain(docs, items)
    assert found == want
    assert any(v[4] for v in want.values())


CASES = [
    (1, "A b c"), (2, "one"), (3, "two words"), (4, "x x x x x x x x x x x x x"), (5, "é Ü tail end"),
    (6, "p q r s t u v w x y z"), (7, "---"), (8, None),
]
TEXTS = [
    (1, "a, B; c! one and two  words"), (2, "x " * 40), (3, "é Ü tail end é ü tail end"), (4, "q r s t u v w x y z p"),
    (5, "p q r s t u v w x y zz"), (6, "p q r s t u v w x"), (7, "wordstwo words one-one"), (8, "a b"), (9, "p.q.r.s.t.u.v.w.x.y.z"),
]


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_ROWS, 0])
def test_short_items_and_overlaps(spark, monkeypatch, bound):
    """With and without broadcasts the same."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    items = spark.createDataFrame(CASES, "item_id long, text string")
    found = {
        r["doc_id"]: (r["n_words"], r["n_hit"], ",".join(r["items"]))
        for r in decontaminate.contamination(docs, items).collect()
    }
    want = plain(TEXTS, CASES)
    assert {d: v[:2] for d, v in found.items()} == {d: v[:2] for d, v in want.items()}
    assert {d: hashlib.sha256(v[2].encode()).hexdigest() for d, v in found.items()} == {d: v[3] for d, v in want.items()}


def test_no_python_in_the_plan(spark, folder):
    plan = queries.op3_decontaminate(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
