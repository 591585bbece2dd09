"""Repeated passages against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swipewatch.llm import substrings
from swipewatch.llm.substrings import SpanPolicy

SHORT = SpanPolicy(window=6, anchor=3, known_words=20)


def brute(rows, window=50):
    """Per row (n_words, n_removed, digest of what is kept); a null id is the greatest."""
    least = {}
    rank = lambda d: (d is None, d or 0)
    texts = [(rank(d), (t or "").encode().split()) for d, t in rows]
    for d, words in texts:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            least[w] = min(least.get(w, d), d)
    out = []
    for d, words in texts:
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, p=SHORT):
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, first int").repartition(3)
    out = substrings.without_repeats(docs, p=p, with_text=False).collect()
    key = lambda r: (r[0] is None, *map(str, r))
    found = sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out], key=key)
    assert found == sorted([(d, *x) for (d, _), x in zip(rows, brute(rows, p.window))], key=key)
    texts = substrings.without_repeats(docs, p=p).collect()
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in texts)
    assert sorted(r["kept_sha256"] for r in texts) == sorted(r["kept_sha256"] for r in out)


@pytest.mark.parametrize("seed", range(3))
def test_few_words_that_repeat_everywhere(spark, seed):
    """A vocabulary so small that windows branch at nearly every word."""
    dice = random.Random(seed)
    rows = []
    for k in range(60):
        words = [dice.choice("abc") for _ in range(dice.randint(0, 60))]
        if rows and dice.random() < 0.6:
            words[5:5] = (dice.choice(rows)[1] or "").split()[3:30]
        rows.append((dice.randint(0, 40), dice.choice([" ", "\n", "  \t"]).join(words)))
    check(spark, rows + [(None, rows[0][1]), (None, rows[1][1]), (3, None), (4, ""), (5, " \x0b ")])


def test_window_in_a_smaller_document_under_another_stretch(spark):
    """The smallest holder of an edge differs from that of the stretch it stands in."""
    w = [f"w{k}" for k in range(40)]
    rows = [(9, " ".join(w)), (5, " ".join(w[:20])), (3, " ".join(["x", *w[8:18], "y"])), (1, " ".join(["z", *w[25:]]))]
    rows += [(7, " ".join(w + w)), (7, " ".join(w)), (8, " ".join(w)), (8, " ".join(w))]
    check(spark, rows)


def test_stored_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = {r["doc_id"]: tuple(r)[1:] for r in substrings.without_repeats(docs, with_text=False).collect()}
    want = {d: x for (d, _), x in zip(rows, brute(rows))}
    assert found == want and sum(x[1] > 0 for x in want.values()) > 20


def test_spans_name_their_source(spark):
    passage = " ".join(f"p{k}" for k in range(80))
    rows = [(1, f"a b {passage} c"), (2, f"x {passage} y z"), (3, f"{passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {(r["doc_id"], r["first"], r["end"], r["source_id"], r["source_first"]) for r in substrings.repeated_spans(docs).collect()}
    assert spans == {(2, 1, 81, 1, 2), (3, 0, 80, 1, 2)}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.without_repeats(docs, with_text=False).count() == 0


def test_least_places_and_shingles():
    dice = np.random.default_rng(2)
    for width in range(1, 9):
        x = dice.integers(0, 5, 40).astype(np.uint64)
        assert substrings.least_places(x, width).tolist() == [i + int(np.argmin(x[i : i + width])) for i in range(41 - width)]
        h = substrings.shingle_hashes(x, width)
        alike = {}
        for i in range(41 - width):
            alike.setdefault(tuple(x[i : i + width].tolist()), set()).add(int(h[i]))
        assert len(h) == 41 - width and all(len(v) == 1 for v in alike.values())
        assert len(set.union(*alike.values())) == len(alike)


def test_long_text_and_a_passage_everywhere(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit(f" {passage} end")).alias("text"))
    long = spark.createDataFrame([(-1, " ".join(f"word{k % 977}" for k in range(60_000)))], "doc_id long, text string")
    out = {r["doc_id"]: r["n_removed"] for r in substrings.without_repeats(docs.union(long)).collect()}
    assert out[-1] == 0 and out[0] == 0 and set(out[k] for k in range(1, 300)) == {61}
