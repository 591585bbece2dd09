"""Archives: round trip, revisits, order of the merged index."""

import base64
import gzip
import hashlib
import random

from swipewatch.llm import queries, warc
from swipewatch.llm.warc import LoserTree


def test_loser_tree_merges():
    dice = random.Random(4)
    for k in (0, 1, 2, 3, 7, 8, 33):
        runs = [sorted(dice.randint(0, 50) for _ in range(dice.randint(0, 30))) for _ in range(k)]
        assert list(LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def _plain(pages, least=0):
    last = {}
    for i, html in pages:
        last[html or ""] = max(i, last.get(html or "", i))
    out = {}
    for i, html in pages:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = len(body) < least or last[html or ""] == i
        out[i] = (len(body), digest, "response" if first else "revisit", None if first else last[html or ""])
    return out


def _found(rows):
    return {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows}


def test_pages(spark, folder):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    assert _found(queries.op6_warc(spark, folder).collect()) == _plain(pages)
    rows = warc.capture_histories(spark.read.parquet(f"{folder}/pages.parquet")).collect()
    in_order = sorted(rows, key=lambda r: (r["part"], r["place"]))
    keys = [(r["url_key"], r["page"]) for r in in_order]
    assert keys == sorted(keys) and len({(r["part"], r["place"]) for r in rows}) == len(rows)


ROWS = [
    (1, "http://www.a.example/x#frag", "same\r\n\r\nbody"), (2, "https://a.example/x", "same\r\n\r\nbody"), (3, None, None),
    (4, "bad\r\nurl: x", ""), (5, "http://b.example:8080/?q=é", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (6, "http://a.example/x", "é€\U0001f600"),
    (7, "http://a.example", "same\r\n\r\nbody"), (8, "http://[bad", "ok"),
]


def test_odd_payloads_and_urls(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    for least in (0, 1):
        rows = warc.capture_histories(pages, least_bytes=least).collect()
        found = {r["page"]: (r["bytes"], r["digest"], r["type"], r["refers"]) for r in rows}
        assert found == _plain([(i, h) for i, _, h in ROWS], least)
    history = [r["page"] for r in sorted(rows, key=lambda r: (r["part"], r["place"])) if r["url_key"] == "example,a)/x"]
    assert history == [1, 2, 6]


def test_hot_url_is_cut_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    pages = spark.createDataFrame([(k, "http://a.example/", f"p{k}") for k in range(600)], "page_id long, url string, html string")
    rows = sorted(warc.capture_histories(pages.repartition(5)).collect(), key=lambda r: (r["part"], r["place"]))
    assert [r["page"] for r in rows] == list(range(600))
    assert max(sum(r["part"] == p for r in rows) for p in {r["part"] for r in rows}) < 200


def test_archives_are_plain_warc(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[:2], "page_id long, url string, html string").coalesce(1)
    from pyspark.sql import functions as F

    made = warc.records(pages, "page_id", "url", "html", F.lit("2024-01-01").cast("timestamp"))
    warc.write_archives(made, str(tmp_path / "w"))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("part-*")))
    records = list(warc.parsed(data))
    kinds = {h["X-Page-ID"]: (h["WARC-Type"], b) for _, h, b in records}
    assert kinds["2"][0] == "response" and kinds["2"][1].endswith(b"\r\n\r\nsame\r\n\r\nbody")
    assert kinds["1"][0] == "revisit" and kinds["1"][1].endswith(b"\r\n\r\n") and b"same" not in kinds["1"][1]
