"""Exact and near copies against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from swipewatch.llm import exact_dedup, simhash
from swipewatch.llm.exact_dedup import CountingQuotientFilter


def test_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 1 << 63, 500, dtype=np.uint64) * 2 for _ in range(4)]
    parts += [parts[0][:100], np.array([0, 0, (1 << 64) - 1], np.uint64)]
    everything = np.concatenate(parts)
    values, counts = np.unique(everything, return_counts=True)
    whole = {}
    for part in parts:
        for block, f in CountingQuotientFilter.of(part, 20).blocks(4):
            whole.setdefault(block, []).append(CountingQuotientFilter.unpacked(*f.packed(), 20))
    merged = [CountingQuotientFilter.merged(fs) for _, fs in sorted(whole.items())]
    assert (np.concatenate([m.prints() for m in merged]) == values).all()
    assert (np.concatenate([m.counts for m in merged]) == counts).all()
    assert set(np.concatenate([m.repeated() for m in merged])) == set(values[counts > 1])


def test_equal_fingerprints_of_different_texts_stay_apart(spark, monkeypatch):
    """Bytes decide: with a fingerprint that is always the same, groups are still those of the texts."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "doc_id long, text string")
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert found == {1: (1, 2, True), 3: (1, 2, False), 2: (2, 1, True), 4: (4, 1, True)}


def _plain_print(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _plain_groups(prints):
    """Smallest id reachable, by comparing all pairs."""
    parent = {d: d for d in prints}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def test_near_groups_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    prints = {r["doc_id"]: _plain_print(r["text"]) for r in docs.collect()}
    found = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_groups(docs).collect()}
    assert found == {d: (prints[d], c) for d, c in _plain_groups(prints).items()}


@pytest.fixture(scope="module")
def chained():
    """Fingerprints in chains of one and two flipped bits, the top bit included, and far ones."""
    rng = np.random.default_rng(5)
    prints = []
    for _ in range(12):
        at = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 25))):
            prints.append(at)
            for b in rng.choice(64, int(rng.integers(0, 4)), replace=False).tolist():
                at ^= 1 << b
    prints += [prints[0] ^ (1 << 63), prints[1] ^ (1 << 63) ^ 1]
    return {int(k): p for k, p in enumerate(rng.permutation(np.array(prints, np.uint64)).tolist())}


def test_links_and_components_are_complete(spark, chained):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(p),) for p in set(chained.values())], "`print` long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes)).collect()}
    want = _plain_groups({signed(p): p for p in set(chained.values())})
    groups = {}
    for node, r in want.items():
        groups.setdefault(r, set()).add(node)
    found = {}
    for p in want:
        found.setdefault(roots.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_bucket_is_bounded(spark):
    """Very many near copies: rows grow with the fingerprints, not with their pairs."""
    prints = [a | b << 8 for a in range(40) for b in range(40)]
    nodes = spark.createDataFrame([(p,) for p in prints], "`print` long")
    assert simhash.links(nodes).count() <= 65 * len(prints)
