"""The pipeline's near copies: one document of each component of SimHash links stays."""

import random

from swipewatch.llm import simhash


def _components(rows):
    """Smallest id per component of fingerprints at most two bits apart, every pair compared."""
    prints = [(d, simhash.fingerprint(t.encode()) % (1 << 64)) for d, t in rows]
    parent = {d: d for d, _ in prints}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for k, (a, x) in enumerate(prints):
        for b, y in prints[:k]:
            if (x ^ y).bit_count() <= simhash.DISTANCE:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d for d in parent if root(d) == d}


def test_large_group(spark):
    """Many long texts that differ in a few words, among unrelated ones."""
    dice = random.Random(4)
    base = [f"w{dice.randint(0, 9999)}" for _ in range(600)]
    rows = []
    for k in range(300):
        words = list(base)
        for at in dice.sample(range(600), dice.randint(0, 3)):
            words[at] = f"x{dice.randint(0, 10**9)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"y{dice.randint(0, 10**9)}" for _ in range(80))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()}
    assert kept == _components(rows) and 50 < len(kept) < 300


def test_ids_with_different_texts(spark):
    a = " ".join(f"w{k}" for k in range(80))
    other = " ".join(f"v{k}" for k in range(80))
    near, near2 = a.upper(), a.replace(" ", "\t")
    docs = spark.createDataFrame([(3, near), (5, a), (5, other), (3, near2)], "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in simhash.drop_near_copies(docs).collect()]
    assert (5, other) in kept and len(kept) == 2 and sorted(d for d, _ in kept) == [3, 5]
