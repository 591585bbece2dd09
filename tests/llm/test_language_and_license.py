"""Languages of pages and licenses in texts."""

import random
from functools import lru_cache

import pytest

from swipewatch.llm import language, license, queries
from swipewatch.llm.license import Templates, aligned, increasing

WORDS = {
    "aa": ["wold", "kern", "sturm", "acht", "regen", "lachen", "dorf"],
    "bb": ["paloma", "verano", "canto", "fuego", "sombra", "lluvia", "rio"],
}


@pytest.fixture(scope="module")
def corpus(spark):
    dice = random.Random(8)
    text = lambda lang, n: " ".join(dice.choice(WORDS[lang]) for _ in range(n))
    docs = spark.createDataFrame([(k, text(lang, 60), lang) for k in range(40) for lang in WORDS] + [(99, None, None)], "doc_id long, text string, lang string")
    page = lambda lang, declared, n: f'<html lang="{declared}"><script>paloma verano</script><p>{text(lang, n)}</p></html>'
    pages = [(k, f"http://h{k % 3}.one.aa/", page("aa", "aa", 30), "aa") for k in range(40)]
    pages += [(100 + k, f"http://h{k % 3}.two.bb/", page("bb", "bb", 30), "bb") for k in range(40)]
    pages += [(200, "http://h1.one.aa/x", '<html lang="bb"></html>', "aa")]  # no text: the host outweighs the markup
    pages += [(201, "http://h1.one.aa/y", page("bb", "aa", 40), "bb")]  # long text outweighs the address
    pages += [(202, "http://new.two.bb/", "<p></p>", "bb"), (203, "http://other.zz.bb/", "", "bb")]  # by domain, by suffix
    return docs, spark.createDataFrame(pages, "page_id long, url string, html string, truth string")


def test_evidence_is_weighed(corpus):
    docs, pages = corpus
    found = {r["page_id"]: r for r in language.identified(pages, docs).collect()}
    assert all(found[r["page_id"]]["language"] == r["truth"] for r in pages.collect())
    assert all(0.5 <= r["probability"] <= 1 for r in found.values())
    assert found[201]["declared"] == "aa" and found[201]["text_language"] == "bb"


def test_pages(spark, folder):
    rows = queries.op1_language(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/pages.parquet").count()
    # the pages' own markup is mostly right
    told = [r for r in rows if r["declared"] in ("en", "de", "fr", "es")]
    assert sum(r["language"] == r["declared"] for r in told) >= 0.8 * len(told)


def _longest(a, b):
    @lru_cache(maxsize=None)
    def go(i, j):
        if i == len(a) or j == len(b):
            return 0
        return go(i + 1, j + 1) + 1 if a[i] == b[j] else max(go(i + 1, j), go(i, j + 1))

    return go(0, 0)


def test_alignment_is_common_and_increasing():
    dice = random.Random(6)
    for _ in range(200):
        a = [dice.choice("abcdefghij") for _ in range(dice.randint(0, 14))]
        b = [dice.choice("abcdefghij") for _ in range(dice.randint(0, 14))]
        pairs = aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= _longest(tuple(a), tuple(b))
    a = dice.sample(range(100), 40)  # all words unique: patience finds a longest common subsequence
    b = sorted(a)
    assert len(aligned(a, b)) == _longest(tuple(a), tuple(b))
    assert [[3, 1, 2, 5, 4][i] for i in increasing([3, 1, 2, 5, 4])] in ([1, 2, 4], [1, 2, 5])


def test_finds():
    known = Templates(license.TEMPLATES, 0.8)
    filler = " ".join(f"w{k}" for k in range(300))
    mit = license.TEMPLATES["MIT"]
    text = f"{filler} {mit} {filler} Released under the MIT License. {filler} {mit.replace('free of charge', 'gratis')}"
    assert [f[0] for f in known.find(text.encode())] == ["MIT", "MIT/statement", "MIT"]
    assert known.find(mit.encode())[0][1:] == (1.0, 0, len(license.words_of(mit.encode())))
    half = " ".join(mit.split()[: len(mit.split()) // 2])
    assert known.find(half.encode()) == [] and known.find(b"") == []
    assert known.find(filler.encode() + b" license and copyright of the work") == []


def test_skipped_documents_have_nothing():
    """The words of which one must be there: without them no template reaches its coverage."""
    known = Templates(license.TEMPLATES, 0.8)
    for words in known.words.values():
        kept = [w for w in words if not any(n in w for n in known.needed)]
        assert len(kept) < known.need(words)


def test_documents(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    short = {k: t for k, t in license.TEMPLATES.items() if k.endswith("/statement")}
    for r in queries.op2_license(spark, folder).collect():
        want = {k for k, t in short.items() if t in (docs[r["doc_id"]] or "")}
        assert want <= set(r["licenses"].split(","))
        assert bool(want) == bool(r["n_found"])
