"""The declared language, wherever the html tag is and however long."""

import re
import time

import pytest

from swipewatch.llm import language


@pytest.mark.parametrize(
    "page, want",
    [
        (b"<!-- " + b"x" * 9000 + b' <html lang="xx"> --><html lang="de-AT">', "de"),
        (b"<script>var a = '<html lang=xx>';" + b" " * 9000 + b"</script >\n<HTML class=a LANG=fr>", "fr"),
        (b" " * 9000 + b"<html data-x='" + b"y" * 900 + b">' lang = 'es'>", "es"),
        (b'<html title="lang=xx" xml:lang="yy" lang="en">', "en"),
        (b'<html xml:lang="yy">', "yy"),
        (b"<html class=a><p lang=de>", ""),
        (b"<htmlx lang=de>", ""),
        (b"<!-- <html lang=de>", ""),
        (b"", ""),
    ],
)
def test_declared(page, want):
    assert language.declared_language(page) == want


def test_linear_time():
    began = time.time()
    for page in (b"<script>" * 200_000, b"<!--" * 400_000, b"<html " + b"a=" * 500_000, b"<html a='" * 200_000, b"<html" + b" " * 10**6):
        assert language.declared_language(page) == ""
    assert time.time() - began < 10


def test_as_before_on_plain_pages(spark, folder):
    old = re.compile(rb"(?is)<html\b[^>]{0,400}?\blang\s*=\s*[\"']?([A-Za-z]{2,3})")
    for r in spark.read.parquet(f"{folder}/pages.parquet").select("html").collect():
        page = bytes(r["html"]) if isinstance(r["html"], (bytes, bytearray)) else (r["html"] or "").encode()
        m = old.search(page[:4096])
        assert language.declared_language(page) == (m[1].decode().lower() if m else "")
