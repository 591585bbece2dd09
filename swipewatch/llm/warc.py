"""Web archives and their index by external merge.

Archives are text files whose line separator is the two line ends that close a WARC record, so Spark's
own writer makes them on any file system. A page is a ``response`` with its payload or, if another
page with an equal payload is one, a ``revisit`` that refers to it and carries headers only.

The index: each archive is parsed where it is read and its captures are put in order (a sorted run).
Runs are dealt by ranges of (URL key, time, id), and in each range a tree of losers merges the runs'
parts. Ranges follow each other, so (``part``, ``place``) is the order of all captures: the histories
of all URLs one after another, each by time. As the range key ends with the id, the captures of one
URL may be cut over several ranges; none is large because of one URL.

A null payload is empty, a null URL is the empty one. Line ends in URLs are percent-encoded. Pages that
share both the largest id and the payload are all responses. Revisits need payloads of at least
``least_bytes``. Without pages there are no archives and no captures.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipewatch.llm.shared import small, stored
from swipewatch.sources.paths import exists, fresh_path

ARCHIVE_RECORDS = 2_000  # in one archive file
RANGE_ROWS = 50_000  # captures in one range
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four letters for each five hexadecimal digits."""
    digest, out = F.sha1(payload), []
    for k in range(8):
        number = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(_BASE32), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def _record_id(id_: Column) -> Column:
    """A name made from the page's id, in the form of a UUID."""
    h = F.md5(F.coalesce(id_.cast("string"), F.lit("")))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def records(pages: DataFrame, id_: str, url: str, html: str, time: Column, least_bytes: int = 0) -> DataFrame:
    """One column ``value``: the WARC record of each page, without the line ends that close it."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(id_).alias("id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        payload.alias("payload"),
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha2(payload, 256).alias("sha"),
    )
    # the texts themselves stay where they are; only digests meet
    equal = rows.where(F.col("bytes") >= least_bytes).groupBy("sha", "bytes").agg(F.max("id").alias("response"), F.count("*").alias("n"))
    equal = small(stored(equal.where("n > 1").drop("n"), "equal_payloads"))
    known = rows.join(equal, ["sha", "bytes"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.col("bytes").cast("string")),
        F.lit("\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    text_id = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("id"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.coalesce("date", F.lit("1970-01-01T00:00:00Z"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))),
        line("X-Page-ID", text_id(F.col("id"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit(_PROFILE)),
                line("WARC-Refers-To", _record_id(F.col("response"))),
                line("X-Refers-To-Page-ID", text_id(F.col("response"))),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return known.select(F.concat(head, block).alias("value"))


def write_archives(made: DataFrame, path: str) -> None:
    """Compressed archive files below ``path``."""
    made.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def url_key(url: str) -> str:
    """Sort-friendly form: host labels from the right, then the path; no scheme, fragment or leading www."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + query


def parsed(archive: bytes):
    """(offset, headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(archive):
        stop = archive.index(b"\r\n\r\n", at)
        first, *lines = archive[at:stop].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}: {first[:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        yield at, headers, archive[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


_FIELDS = ("url_key", "time", "page", "bytes", "digest", "type", "refers", "file", "offset")
_RUN = "url_key string, time string, page string, bytes long, digest string, type string, refers string, file string, offset long"
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]


def _captures(content: bytes, file: str) -> list:
    """The sorted run of one archive; payloads are checked against their digests."""
    rows = []
    for offset, h, block in parsed(zlib.decompress(content, 31)):
        http, payload = block.split(b"\r\n\r\n", 1)
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        if h["WARC-Type"] == "response":
            if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{file}, {offset}: payload and digest differ")
        refers = h.get("X-Refers-To-Page-ID") or None
        page = h["X-Page-ID"] or None
        rows.append((url_key(h["WARC-Target-URI"]), h["WARC-Date"], page, size, digest, h["WARC-Type"], refers, file, offset))
    return sorted(rows, key=_order)


def _order(row) -> tuple:
    page = row[2]
    number = page is not None and page.lstrip("-").isdigit()
    return row[0], row[1], page is not None, int(page) if number else 0, page or "", row[7], row[8]


def runs(spark, path: str) -> DataFrame:
    """The captures of all archives below ``path``, each archive's in order."""

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = _captures(content, file)
                if found:
                    columns = [pa.array(c, t) for c, t in zip(zip(*found), _TYPES)]
                    yield pa.RecordBatch.from_arrays(columns, list(_FIELDS))

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(run, _RUN)


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers of their matches, the root's winner comes out.

    Taking one element costs one match per level, whatever the number of runs.
    """

    def __init__(self, runs: list, key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k  # -1: no match yet; it wins against all
        self.winner = -1
        for i in range(self.k):
            self._replay(i)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), row)

    def _beats(self, i: int, j: int) -> bool:
        if i < 0 or j < 0:
            return i < 0
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (a[0], i) < (b[0], j)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.winner = winner

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][1]
            self.heads[i] = self._next(i)
            self._replay(i)


def merged(captures: DataFrame, rows: int) -> DataFrame:
    """All captures in order of (``part``, ``place``): by URL key, time and id."""
    ranges = max(1, -(-rows // RANGE_ROWS))

    def run(batches):
        of_run = {}
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(len(_FIELDS)))):
                of_run.setdefault(row[7], []).append(row)
        parts = []
        for file in sorted(of_run):
            own = of_run[file]
            own.sort(key=_order)  # in order already unless the shuffle changed it; then linear
            parts.append(own)
        out = list(LoserTree(parts, _order))
        for k in range(0, len(out), 10_000):
            part = out[k : k + 10_000]
            columns = [pa.array(c, t) for c, t in zip(zip(*part), _TYPES)]
            columns += [pa.array([TaskContext.get().partitionId()] * len(part), pa.int64()), pa.array(range(k, k + len(part)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*_FIELDS, "part", "place"])

    key = [F.col("url_key"), F.col("time"), F.expr("try_cast(page AS decimal(38,0))"), F.col("page"), F.col("file"), F.col("offset")]
    return captures.repartitionByRange(ranges, *key).mapInArrow(run, _RUN + ", part long, place long")


def capture_histories(
    pages: DataFrame, id_: str = "page_id", url: str = "url", html: str = "html", time: Column | None = None, least_bytes: int = 0
) -> DataFrame:
    """Writes all pages to archives, reads these back and gives their captures in order.

    Without ``time`` all pages were captured at one fixed moment. ``page`` and ``refers`` have the
    type of the id column.
    """
    spark = pages.sparkSession
    time = F.lit("2024-01-01 00:00:00").cast("timestamp") if time is None else time
    path = fresh_path(spark, "archives")
    write_archives(records(pages, id_, url, html, time, least_bytes), path)
    kind = pages.schema[id_].dataType
    captures = stored(runs(spark, f"{path}/part-*") if exists(spark, f"{path}/part-*") else spark.createDataFrame([], _RUN), "runs")
    out = merged(captures, captures.count())
    return out.withColumn("page", F.col("page").cast(kind)).withColumn("refers", F.col("refers").cast(kind))

