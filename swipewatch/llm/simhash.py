"""SimHash near-duplicates by multi-index hashing.

The fingerprint is cut into segments. In each segment the small Hamming ball around the
fingerprint's value is enumerated while the other segments stay; the results are the keys under
which the fingerprint stands in the tables. Two fingerprints that differ in two bits i and j meet:
one of them flips i, the other flips j, and both arrive at the same key. So nothing is lost, and a
bucket holds at most 65 different fingerprints however many near copies there are: a key made of
one segment alone would bring all near copies of a group into one bucket and all their pairs into
the plan. Within a bucket each fingerprint is linked with the smallest one, the whole distance is
verified, and the links' components are found by alternating stars.

Null and empty texts have fingerprint zero and are linked like any other. Rows with the same
fingerprint are one node, whatever their number. Null ids take part; a component's id is the
smallest id that is not null, or null if there is none.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm.shared import fresh_name, small, stored, text_batches, whole_text

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEGMENTS = 4
SEGMENT_BITS = 64 // SEGMENTS
DISTANCE = 2
NODES_PER_TASK = 20_000
_STEP = 1 << 14  # shingles counted at a time


def fingerprint(text: bytes, width: int = 3) -> int:
    """Signed 64-bit SimHash of UTF-8 bytes: majority of the bits of the shingles' XXH64, seed 42."""
    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= width:
        hashes = np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[: n - width]]
        spans = [line[a : b - 1] for a, b in zip(starts, ends[width - 1 :])]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(42)), np.uint64, len(spans))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _STEP):
        bits = np.unpackbits(hashes[k : k + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    value = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return int(value.astype(np.int64))


def with_fingerprints(docs: DataFrame, id_: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, ``mark`` hash of the text, ``print`` long) of each row."""

    def run(batches):
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            prints = np.fromiter((fingerprint(t, width) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints)], ["id", "mark", "print"])

    whole = whole_text(text)
    narrow = text_batches(docs).select(F.col(id_).alias("id"), F.xxhash64(whole).alias("mark"), whole.alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, mark long, `print` long")


def ball(column: str) -> F.Column:
    """The keys of a fingerprint: itself, and each segment's values at distance one, the others kept."""
    masks = [0]
    for segment in range(SEGMENTS):
        for bit in range(SEGMENT_BITS):
            mask = 1 << (segment * SEGMENT_BITS + bit)
            masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return F.array(*[F.col(column).bitwiseXOR(F.lit(m).cast("long")) for m in masks])


def links(nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """(a, b) with a < b, at most two bits apart, whose components are those of all such pairs of ``print``.

    ``rows``, if known, is the most rows that ``nodes`` may have. Each makes 65, so they are dealt
    over more tasks than their own size would suggest.
    """
    spread = nodes if rows is None else nodes.repartition(rows // NODES_PER_TASK + 1, "print")
    met = (
        spread.select("print", F.explode(ball("print")).alias("key"))
        .groupBy("key")
        .agg(F.min("print").alias("a"), F.max("print").alias("z"), F.collect_list("print").alias("all"))
        .where("a < z")
    )
    pairs = met.select("a", F.explode("all").alias("b")).where("a < b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); root is the smallest node of its component.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest
    neighbour, until only stars are left. Minima are aggregated map-side before each join, so that
    a node with very many neighbours is no bottleneck.
    """
    edges = stored(edges.select("a", "b"), "links")
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").distinct()
        # now each edge (a, b) has a < b; point the smaller neighbours of b at its smallest one
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        star = joined.select(F.col("m").alias("a"), "b").union(
            joined.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        )
        new = stored(star.distinct(), "links")
        a_nodes = new.select(F.col("a").alias("n")).distinct()
        inner = a_nodes.join(new.select(F.col("b").alias("n")), "n", "left_semi").limit(1).count()
        twice = new.groupBy("b").count().where("count > 1").limit(1).count() if not inner else 1
        edges = new
        if not inner and not twice:
            roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return roots.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def rooted(prints: DataFrame) -> DataFrame:
    """(``print``, root) of each different fingerprint of ``prints`` (stored), stored; root stands for its component."""
    nodes = prints.select("print").distinct()
    roots = components(links(nodes, prints.count()))
    joined = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left")
    return stored(joined.select("print", F.coalesce("root", "print").alias("root")), "roots")


def near_groups(docs: DataFrame, id_: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id``."""
    prints = stored(with_fingerprints(docs, id_, text, width), "fingerprints")
    nodes = prints.groupBy("print").agg(F.min("id").alias("low")).join(rooted(prints), "print")
    nodes = stored(nodes, "nodes")
    lowest = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = nodes.join(lowest, "root").select("print", "component_id")
    out = prints.join(named, "print")
    return out.select(
        F.col("id").alias(id_), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id_: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with one document of each component of ``near_groups``: the one with the smallest id.

    Of different texts under that id the one with the smallest hash stays; a text outside the group is never
    removed for its id. Rows alike in id and text (which exact deduplication removes) stay, as do rows without id.
    """
    prints = stored(with_fingerprints(docs, id_, text, width), "fingerprints")
    own = F.when(F.col("id").isNotNull(), F.struct("id", "mark"))
    nodes = stored(prints.groupBy("print").agg(F.min(own).alias("low")).join(rooted(prints), "print"), "nodes")
    lowest = nodes.groupBy("root").agg(F.min("low").alias("lowest"))
    named = nodes.join(lowest, "root").select("print", "lowest")
    gone = prints.join(named, "print").where(own != F.col("lowest"))
    gone = small(stored(gone.select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct(), "gone"))
    mark = fresh_name(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64(whole_text(text)))
    same = (marked[id_] == gone["gone_id"]) & (marked[mark] == gone["gone_mark"])
    return marked.join(gone, same, "left_anti").drop(mark)
