"""Packing: exact ids, whole coverage, little padding; the dynamic programme against all cuts."""

import itertools
import zlib

import numpy as np
import pytest

from swipewatch.llm import packing
from swipewatch.llm.packing import PackPolicy, Tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [
    "ÀÉß straße ǅ Σς ΑΣ İstanbul ﬁne éa naïve's don't it's..., <|endoftext|> a<|startoftext|>b 'tis x''y z\x1cq",
    "汉字。漢 ½ 1234 a1b2 ñ!!?? $$$%%% ªº ĲŁ ŉa \x00a\x01 ß ÿ þ Ÿ ĸ́ é", "", " ", "'s", "a'", "é'", "a b c", "x" * 700,
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda texts: [e.ids + [2] for e in t.encode_batch(list(texts), add_special_tokens=False)]


def test_odd_texts(plain):
    ids, sizes = Tokens(None, 1000).encode([t.encode() for t in ODD], 2)
    ends = np.r_[0, np.cumsum(sizes)]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == plain(ODD)


def checked(rows, texts, plain, width=4096):
    """Every id in one piece, sequences without gaps; returns the share of padding."""
    by_doc, ids = {}, dict(zip(texts, plain(t or "" for t in texts.values())))
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        at, want = 0, np.array(ids[doc], "<u4")
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["length"] > 0
            assert zlib.crc32(want[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = total = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= width
        padding += 0 if at & (at - 1) == 0 else width - at
        total += at
    return padding / total


def test_documents(spark, folder, plain):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert checked(packing.packed(docs).collect(), texts, plain) < 0.02


def test_short_stretches_carry_over(spark, folder, plain):
    """Documents that are cut over several calls keep their places; ids are returned on demand."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packing.packed(docs, policy=PackPolicy(width=256, stretch=2000), with_ids=True).collect()
    checked(rows, texts, plain, 256)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)


def test_cuts_are_the_cheapest():
    p = PackPolicy(width=20)
    rng = np.random.default_rng(1)
    for _ in range(30):
        pos = np.cumsum(rng.integers(1, 9, 9))
        cost = rng.choice([0.0, 4.0, 24.0], 9)

        def total(cuts):
            at, out = 0, 0.0
            for c in cuts:
                if pos[c] - at > p.width:
                    return np.inf
                out, at = out + p.width - (pos[c] - at) + cost[c], pos[c]
            return out

        every = [(*c, 8) for n in range(9) for c in itertools.combinations(range(8), n)]
        best = min(map(total, every))
        made = packing.cut_points(pos, cost, p)
        assert total([pos.tolist().index(x) for x in made]) == best


def test_last_window():
    p = PackPolicy()
    assert packing.last_windows(0, 4000, p) == [4000]
    assert packing.last_windows(10, 10 + 1280, p) == [1034, 1290]
    assert packing.last_windows(0, 4096, p) == [4096]
