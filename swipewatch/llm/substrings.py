"""Repeated passages by compaction of a de Bruijn graph of tokens.

An edge of the graph is a k-mer of ``window`` consecutive words of one document, its nodes are the first and
the last ``window - 1`` of them. Consecutive edges of a document that share their least ``anchor``-word shingle (by
hash; the leftmost, if several are alike) form a stretch. The shingle depends on the edge's words alone, so all
occurrences of an edge stand in stretches of one anchor.

1. One pass turns each text into its stretches: anchor, digest of the stretch's words, place.
2. Stretches are grouped by anchor, map-side combined. Where all occurrences of an anchor have one digest, the
   graph doesn't branch there: the stretch is compacted and stands for all its edges at once. The occurrence in
   the document with the smallest id is its source.
3. At anchors with several digests the graph branches. Each digest's stretch gets its own source. The sources
   themselves are taken apart into edges, once however often their document repeats them, and the edges are
   grouped by digest.
4. Stretches and edges whose source is a smaller document have coordinates there, and the words at both coordinates
   have one digest. Those that go on at the same distance from the same source are one long repeated span.
   Its words go.

Null and empty texts have no words. Ids are compared as they are; a null id is greater than all others and no
null id is smaller than another, nor is a row's id smaller than itself where rows share it. Rows alike in id and
text have the same result. Digests have 128 bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm.shared import small, stored, text_batches, whole_text

_ODD = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class SpanPolicy:
    window: int = 50
    anchor: int = 16
    known_words: int = 200_000  # different words a worker keeps the hashes of


class _Hashes(dict):
    def __missing__(self, word):
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found


def word_hashes(words: list, known: _Hashes, p: SpanPolicy) -> np.ndarray:
    if len(known) > p.known_words:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on, from those of half as many."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    power, size, out, done, base = words, 1, np.zeros(len(words) + 1, np.uint64), 0, _ODD
    rest = width
    while rest:
        factor = np.uint64(base)
        if rest & 1:
            # what is there so far, then ``size`` more words
            more = power[done : done + len(words) - width + 1]
            out = out[: len(more)] * factor + more
            done += size
        rest >>= 1
        if rest:
            power = power[:-size] * factor + power[size:]
            base, size = base * base % (1 << 64), size * 2
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the least, the leftmost one if several are alike."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at, size = values, np.arange(len(values)), 1

    def both(step: int):
        right = low[step:] < low[:-step]
        return np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])

    while size * 2 <= width:
        low, at = both(size)
        size *= 2
    if size < width:
        low, at = both(width - size)
    return at[:n]


class Line:
    """Words of a text, joined by one space, with their ends."""

    def __init__(self, words: list):
        self.joined = b" ".join(words)
        self.ends = list(accumulate(map(len, words), lambda a, n: a + n + 1, initial=0))  # start of the next word

    def digest(self, first: int, end: int) -> bytes:
        return xxhash.xxh3_128_digest(self.joined[self.ends[first] : self.ends[end] - 1], 42)


def stretches(text: bytes, known: _Hashes, p: SpanPolicy) -> tuple:
    """(number of words, their SHA-256, first edge of each stretch, its anchor, its two-part digest)."""
    words = text.split()
    line = Line(words)
    sha = hashlib.sha256(line.joined).hexdigest()
    n = len(words)
    if n < p.window:
        return n, sha, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    shingles = shingle_hashes(word_hashes(words, known, p), p.anchor)
    at = least_places(shingles, p.window - p.anchor + 1)
    firsts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    ends = np.r_[firsts[1:], len(at)] + (p.window - 1)
    digests = b"".join(map(line.digest, firsts.tolist(), ends.tolist()))
    parts = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return n, sha, firsts.astype(np.int32), shingles[at[firsts]].view(np.int64), parts


def _lists(arrays: list, kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


_SAME = "t.id <=> c.id AND t.mark = c.mark"
FEW_PLACES = 2_000_000  # pairs of numbers that may be broadcast: about 16 MB


def _per_text(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """(id, mark, ``name``) as ``c``, stored: the different ``columns`` of each text, marked for broadcast if counted small."""
    found = stored(rows.groupBy("id", "mark").agg(F.collect_set(F.struct(*columns)).alias(name)), name)
    few = (found.agg(F.sum(F.size(name))).first()[0] or 0) <= FEW_PLACES
    return (small(found) if few else found).alias("c")


def _texts(docs: DataFrame, id_: str, text: str) -> DataFrame:
    whole = whole_text(text)
    return docs.select(F.col(id_).alias("id"), F.xxhash64(whole).alias("mark"), whole.alias("text"))


def _read(docs: DataFrame, id_: str, text: str, p: SpanPolicy) -> DataFrame:
    """(id, mark, n_words, sha, firsts, anchors, d0, d1) of each row, stored."""
    rows = text_batches(_texts(docs, id_, text))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "mark", "n_words", "sha", "firsts", "anchors", "d0", "d1"]

    def run(batches):
        known = _Hashes()
        for b in batches:
            made = [stretches(t, known, p) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([m[0] for m in made], pa.int64()),
                    pa.array([m[1] for m in made], pa.string()),
                    _lists([m[2] for m in made], pa.int32()),
                    _lists([m[3] for m in made], pa.int64()),
                    _lists([m[4][:, 0] for m in made], pa.int64()),
                    _lists([m[4][:, 1] for m in made], pa.int64()),
                ],
                names,
            )

    schema = f"id {kind}, mark long, n_words long, sha string, firsts array<int>, anchors array<long>, d0 array<long>, d1 array<long>"
    return stored(rows.mapInArrow(run, schema), "stretches")


def _source(first: str) -> F.Column:
    """Orders occurrences by id, null last, then place; the smallest is the source."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", F.col(first).alias("first"))


# whether a row's source is in a smaller document
_SMALLER = "id IS NULL AND source.id IS NOT NULL OR source.id < id"


def _taken_apart(docs: DataFrame, wanted: DataFrame, id_: str, text: str, p: SpanPolicy) -> DataFrame:
    """(id, mark, stretch, first, d0, d1) of each edge in the stretches ``wanted`` (id, mark, first, n), stored;
    ``stretch`` is the first edge of its stretch."""
    asked = _per_text(wanted, "asked", "first", "n")
    rows = _texts(docs, id_, text).alias("t").join(asked, F.expr(_SAME))
    rows = text_batches(rows.select("t.id", "t.mark", "t.text", "asked"))
    kind = docs.schema[id_].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k, t in enumerate(b.column(2).cast(pa.binary())):
                line, asked = Line(t.as_py().split()), b.column(3)[k].values
                starts, sizes = (asked.field(c).to_numpy() for c in (0, 1))
                firsts = np.concatenate([np.arange(f, f + n) for f, n in zip(starts.tolist(), sizes.tolist())])
                digests = b"".join([line.digest(f, f + p.window) for f in firsts.tolist()])
                parts = np.frombuffer(digests, np.int64).reshape(-1, 2)
                whose = [pa.array([b.column(c)[k].as_py()] * len(firsts), b.column(c).type) for c in (0, 1)]
                places = [pa.array(a.astype(np.int32)) for a in (np.repeat(starts, sizes), firsts)]
                columns = [*whose, *places, pa.array(parts[:, 0].copy()), pa.array(parts[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "stretch", "first", "d0", "d1"])

    return stored(rows.mapInArrow(run, f"id {kind}, mark long, stretch int, first int, d0 long, d1 long"), "edges")


def _repeats(docs: DataFrame, read: DataFrame, id_: str, text: str, p: SpanPolicy) -> DataFrame:
    """(id, mark, first, n, source), stored: ``n`` edges from ``first`` on whose words the smaller document ``source`` has."""
    zipped = F.inline(F.arrays_zip("firsts", "anchors", "d0", "d1", "n"))
    last = F.greatest(F.col("n_words") - (p.window - 1), F.lit(0)).cast("int")
    # edges up to the next stretch, or up to the last edge of the text
    sizes = F.transform("firsts", lambda f, k: F.coalesce(F.get("firsts", k + 1), last) - f)
    each = (
        read.where(F.size("firsts") > 0)
        .withColumn("n", sizes)
        .select("id", "mark", zipped)
        .withColumnsRenamed({"firsts": "first", "anchors": "anchor"})
    )
    branching = F.expr("min(d0) < max(d0) OR min(d1) < max(d1)").alias("branching")
    anchors = each.groupBy("anchor").agg(F.count("*").alias("many"), branching, F.min(_source("first")).alias("source"))
    anchors = stored(anchors.where("many > 1").drop("many"), "anchors")
    met = stored(each.join(small(anchors), "anchor"), "met")
    compact = met.where(f"NOT branching AND ({_SMALLER})").select("id", "mark", "first", "n", "source")

    branches = met.where("branching").drop("source")
    sources = branches.groupBy("d0", "d1").agg(F.count("*").alias("many"), F.min(_source("first")).alias("source"))
    # what occurs once has no other source; the table of the rest is written, so that Spark can split a digest's rows
    sources = stored(sources.where("many > 1").drop("many"), "sources")
    branches = stored(branches.join(sources, ["d0", "d1"], "left"), "branches")
    settled = branches.where(_SMALLER).select("id", "mark", "first", "n", "source")
    # the rest have their source in their own document, or none: a digest is taken apart at its source only
    left = branches.where(f"NOT coalesce({_SMALLER}, false)")
    firsts = left.where("source IS NULL OR source.first = first")
    again = left.where("source.first < first").select("id", "mark", "first", "d0", "d1").alias("t")
    edges = _taken_apart(docs, firsts.select("id", "mark", "first", "n"), id_, text, p)
    found = edges.groupBy("d0", "d1").agg(F.count("*").alias("many"), F.min(_source("first")).alias("source")).where("many > 1")
    single = edges.join(stored(found.drop("many"), "sources"), ["d0", "d1"]).where(_SMALLER)
    single = stored(single.select("id", "mark", "stretch", "first", F.lit(1).alias("n"), "source"), "single")
    # what was found at the source holds wherever its document has the same words again
    told = firsts.where("source IS NOT NULL").select("id", "mark", F.col("first").alias("stretch"), "d0", "d1").alias("c")
    told = told.join(single.alias("t"), F.expr(f"{_SAME} AND t.stretch = c.stretch"))
    told = told.groupBy("d0", "d1", F.expr("t.first - t.stretch").alias("step")).agg(F.min("t.source").alias("source"))
    repeated = again.join(told, ["d0", "d1"]).selectExpr("id", "mark", "first + step AS first", "1 AS n", "source")
    single = single.drop("stretch").unionByName(repeated)
    return stored(compact.unionByName(settled).unionByName(single), "repeats")


def _joined(repeats: DataFrame, p: SpanPolicy) -> DataFrame:
    """Repeats that go on at the same distance from the same source, as spans of words: (id, mark, first, end, source)."""
    diagonal = "PARTITION BY id, mark, source.id, first - source.first ORDER BY first"
    marked = repeats.selectExpr("*", f"first > lag(first + n) OVER ({diagonal}) AS fresh")
    # edges that follow one another without a gap are one path
    numbered = marked.selectExpr("*", f"count_if(coalesce(fresh, true)) OVER ({diagonal}) AS path")
    return numbered.groupBy(
        "id", "mark", F.col("source.id").alias("source_id"),
        F.expr("first - source.first").alias("shift"), "path",
    ).agg(F.min("first").alias("first"), F.expr(f"max(first + n) + {p.window - 1}").alias("end"))


def repeated_spans(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", p: SpanPolicy = SpanPolicy(), read: DataFrame | None = None
) -> DataFrame:
    """One row per repeated span of a different (id, text): id, ``mark`` (hash of the text), ``first`` and ``end`` in words,
    ``source_id``, ``source_first`` (of a row with that id, where several share it). Stored; spans of a text may overlap."""
    read = _read(docs, id_, text, p) if read is None else read
    spans = _joined(_repeats(docs, read, id_, text, p), p).selectExpr(
        "*", "first - shift AS source_first"
    ).drop("shift", "path")
    return stored(spans.withColumnRenamed("id", id_), "spans")


def without_repeats(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", p: SpanPolicy = SpanPolicy(), with_text: bool = True
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_sha256``, and ``kept_text`` if asked for."""
    read = _read(docs, id_, text, p)
    spans = repeated_spans(docs, id_, text, p, read).withColumnRenamed(id_, "id")
    cut = _per_text(spans, "cut", "first", "end")
    kind = docs.schema[id_].dataType.simpleString()
    names = ["id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]

    def run(batches):
        for b in batches:
            out = []
            for t, cuts in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2)):
                words = t.split()
                steps = np.zeros(len(words) + 1, np.int64)
                if cuts.is_valid:
                    np.add.at(steps, cuts.values.field(0).to_numpy(), 1)
                    np.add.at(steps, cuts.values.field(1).to_numpy(), -1)
                stay = np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()
                left = b" ".join([words[i] for i in stay])
                out.append((len(words), len(words) - len(stay), hashlib.sha256(left).hexdigest(), left)[: len(names) - 1])
            columns = zip(*out) if out else [[]] * (len(names) - 1)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names)

    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept_text binary" if with_text else "")
    if with_text:
        rows = _texts(docs, id_, text).alias("t").join(cut, F.expr(_SAME), "left").select("t.id", "t.text", "cut")
        out = text_batches(rows).mapInArrow(run, schema)
        return out.withColumn("kept_text", F.col("kept_text").cast("string")).withColumnRenamed("id", id_)
    # texts that keep all their words were hashed when they were read
    touched = _texts(docs, id_, text).alias("t").join(cut, F.expr(_SAME)).select("t.id", "t.text", "cut")
    whole = read.alias("t").join(cut, F.expr(_SAME), "left_anti")
    whole = whole.select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return text_batches(touched).mapInArrow(run, schema).unionByName(whole).withColumnRenamed("id", id_)
