"""Tokenizer alignment against plain loops over tokens, and sparse products against dense ones."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from swipewatch.llm import alignment
from swipewatch.llm.csr import Csr

SMALL = alignment.AlignPolicy(chunk_links=300, batch_bytes=100)
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum", "groups_sha256")


def _tokenizers():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def _symbols():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 256
    for b in range(256):
        out[chr(b) if b in shown else chr(extra)] = b
        extra += b not in shown
    return out


def _spans(pieces):
    out, at = [], 0
    for number, b in pieces:
        out.append((number, at, at + len(b)))
        at += len(b)
    return out


def brute(texts):
    tok_a, tok_b = _tokenizers()
    symbols, per_doc, holders = _symbols(), [], defaultdict(set)
    for n, t in enumerate(texts):
        want = (" " + (t or "")).encode()
        a, b = [], []
        if t:
            e = tok_a.encode(" " + t, add_special_tokens=False)
            a = [(i, bytes(symbols[c] for c in tok_a.id_to_token(i))) for i in e.ids]
            for i in tok_b.encode(t):
                piece = tok_b.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if tok_b.is_byte(i) else piece.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a, b = [], []
        a, b = _spans(a), _spans(b)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for c in cuts:
            groups.append(([i for i, s, e in a if start <= s and e <= c], [i for i, s, e in b if start <= s and e <= c]))
            start = c
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        for pair in set(links):
            holders[pair].add(n)
        overlaps = sum(1 for _, s, e in a for _, u, v in b if max(s, u) < min(e, v))
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if a else ""
        per_doc.append((len(a), len(b), len(groups), links, overlaps, digest))
    count = {k: len(v) for k, v in holders.items()}
    most = Counter()
    for (x, _), c in count.items():
        most[x] = max(most[x], c)
    return [
        (na, nb, ng, len(links), over, sum(count[k] == most[k[0]] for k in links), sum(count[k] for k in links), digest)
        for na, nb, ng, links, over, digest in per_doc
    ]


ODD = [
    None,
    "",
    " ",
    "  two  spaces\n\n\tand tabs   x\x85y\xa0z　w \x1c\x1f end  ",
    "<|endoftext|> <s> </s> it's we'll I'M",
    "▁ is no space",
    "汉字 \U0001f600 é é ﬁ",
    "plain words, plain words",
    "plain words, plain words",
    "x" * 3_000,
    "\x00 zero \r\n",
    "1234567 12,345.67 ---- ....",
]


def found(spark, texts, policy):
    rows = [(k, t, k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int").repartition(3)
    out = alignment.aligned(docs, p=policy).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in out] == list(range(len(texts)))
    return [tuple(r[c] for c in COLUMNS) for r in out]


@pytest.mark.parametrize("policy", [SMALL, alignment.AlignPolicy()])
def test_odd_texts(spark, policy):
    assert found(spark, ODD, policy) == brute(ODD)


def test_stored_documents(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    texts = [r["text"] for r in rows][:120]
    assert found(spark, texts, SMALL) == brute(texts)


def test_invalid_bytes_and_none(spark):
    docs = spark.sql("SELECT cast(1 AS bigint) AS doc_id, cast(x'ff41' AS string) AS text")
    (r,) = alignment.aligned(docs).collect()
    assert tuple(r[c] for c in COLUMNS) == (0,) * 7 + ("",)
    empty = alignment.aligned(docs.limit(0))
    assert empty.columns == ["doc_id", *COLUMNS] and empty.count() == 0


def test_token_links(spark):
    docs = spark.createDataFrame([(None, "tokenizers disagree"), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in alignment.token_links(docs).collect()}
    r = out[None]
    assert sum(x["bytes"] for x in r["overlaps"]) == len(" tokenizers disagree") == r["a_ends"][-1] == r["b_ends"][-1]
    assert set(r["group_ends"]) == set(r["a_ends"]) & set(r["b_ends"])
    assert out[2]["a"] == [] and out[2]["overlaps"] == []


def test_products_equal_dense():
    dice = np.random.default_rng(5)
    for _ in range(50):
        m, k, n = dice.integers(0, 9, 3)
        x, y = dice.integers(0, 3, (m, k)), dice.integers(0, 3, (k, n))

        def csr(d):
            rows, columns = np.nonzero(d)
            return Csr(np.r_[0, np.cumsum((d != 0).sum(1))].astype(np.int64), columns.astype(np.int64), d[rows, columns], d.shape[1])

        def dense(c):
            out = np.zeros((c.height, c.width), np.int64)
            out[c.rows(), c.indices] = c.values
            return out

        assert (dense(csr(x).times(csr(y))) == x @ y).all()
        assert (dense(csr(x).transposed()) == x.T).all()


def test_repeated_rows_count_twice(spark):
    docs = spark.createDataFrame([(1, "same")] * 2, "doc_id long, text string")
    one = alignment.aligned(docs.limit(1)).first()
    assert [r["count_sum"] for r in alignment.aligned(docs).collect()] == [2 * one["count_sum"]] * 2


def test_every_pair_of_a_group_is_a_link(spark, folder):
    made = alignment.aligned(spark.read.parquet(f"{folder}/documents.parquet"))
    assert made.where("n_links < greatest(n_a, n_b) OR n_overlaps > n_links OR n_best > n_links OR count_sum < n_links").count() == 0
    assert made.agg(F.sum("n_links")).first()[0] > 100_000
