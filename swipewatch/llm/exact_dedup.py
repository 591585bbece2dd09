"""Exact copies: counting quotient filters find repeated fingerprints, bytes decide.

1. Each partition puts the 64-bit fingerprints of its normalised texts into a counting quotient
   filter: the upper bits (quotient) name a slot, the lower ones (remainder) are stored in order
   with a count. The filter is cut into blocks of neighbouring slots.
2. Blocks of the same slots are merged by their sorted remainders. Nothing is approximated: quotient
   and remainder together are the whole fingerprint.
3. Rows whose fingerprint counts more than one are compared byte by byte (Spark groups by the text
   itself, map-side first, so that a large group of copies shrinks before it is shuffled). All
   other rows are known to be alone and their texts never move.

Null texts are empty texts. A null id takes part; it is the smallest only where no other id is
there. Rows equal in id and text count towards the group's size; exactly one of them stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipewatch.llm.shared import fresh_name, small, stored, whole_text

BLOCK_ROWS = 1_000_000  # fingerprints a merged block holds on average
FLUSH_ROWS = 4_000_000  # fingerprints a task gathers before it emits a filter


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; single spaces are left alone to save work."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


class CountingQuotientFilter:
    """Fingerprints as quotients (slots with run lengths) and sorted remainders with counts."""

    def __init__(self, slots: np.ndarray, lengths: np.ndarray, remainders: np.ndarray, counts: np.ndarray, bits: int):
        self.slots, self.lengths, self.remainders, self.counts, self.bits = slots, lengths, remainders, counts, bits

    @classmethod
    def of(cls, prints: np.ndarray, bits: int, counts: np.ndarray | None = None) -> "CountingQuotientFilter":
        """A filter of unsigned fingerprints; ``bits`` of each are the quotient."""
        order = np.argsort(prints, kind="stable")  # merges runs that are in order already
        prints = prints[order]
        counts = np.ones(len(prints), np.int64) if counts is None else counts[order]
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.zeros(0, np.int64)
        values, sums = prints[first], np.add.reduceat(counts, first) if len(first) else counts
        quotients = values >> np.uint64(64 - bits)
        slots, lengths = np.unique(quotients, return_counts=True)
        return cls(slots, lengths.astype(np.uint32), values & np.uint64((1 << (64 - bits)) - 1), sums, bits)

    def prints(self) -> np.ndarray:
        return (np.repeat(self.slots, self.lengths) << np.uint64(64 - self.bits)) | self.remainders

    @classmethod
    def merged(cls, filters: list) -> "CountingQuotientFilter":
        """Lossless: the remainders of a slot are merged in order, equal ones add their counts."""
        return cls.of(np.concatenate([f.prints() for f in filters]), filters[0].bits, np.concatenate([f.counts for f in filters]))

    def blocks(self, block_bits: int):
        """(block, filter) for each range of slots that is not empty."""
        block = self.slots >> np.uint64(self.bits - block_bits)
        ends = np.r_[0, np.cumsum(self.lengths, dtype=np.int64)]
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            r = slice(ends[a], ends[b])
            yield int(block[a]), CountingQuotientFilter(self.slots[a:b], self.lengths[a:b], self.remainders[r], self.counts[r], self.bits)

    def packed(self) -> tuple:
        return tuple(x.tobytes() for x in (self.slots, self.lengths, self.remainders, self.counts))

    @classmethod
    def unpacked(cls, slots, lengths, remainders, counts, bits: int) -> "CountingQuotientFilter":
        kinds = (np.uint64, np.uint32, np.uint64, np.int64)
        return cls(*(np.frombuffer(x, k) for x, k in zip((slots, lengths, remainders, counts), kinds)), bits)

    def repeated(self) -> np.ndarray:
        return self.prints()[self.counts > 1]


_PACKED = "block int, slots binary, lengths binary, remainders binary, counts binary"


def repeated_fingerprints(prints: DataFrame, column: str, rows: int) -> DataFrame:
    """One column ``column``: the fingerprints that ``prints`` (of about ``rows`` rows) holds more than once."""
    block_bits = max(4, (max(rows, 1) // BLOCK_ROWS).bit_length() + 1)
    bits = max(16, block_bits + 10)

    def build(batches):
        held, n = [], 0

        def emit():
            found = CountingQuotientFilter.of(np.concatenate(held), bits)
            rows = [(k, *f.packed()) for k, f in found.blocks(block_bits)]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 4)],
                ["block", "slots", "lengths", "remainders", "counts"],
            )

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy().view(np.uint64))
                n += batch.num_rows
            if n >= FLUSH_ROWS:
                yield emit()
                held, n = [], 0
        if n:
            yield emit()

    def merge(key, table):
        columns = [table.column(c).to_pylist() for c in ("slots", "lengths", "remainders", "counts")]
        found = CountingQuotientFilter.merged([CountingQuotientFilter.unpacked(*x, bits) for x in zip(*columns)])
        return pa.table({column: pa.array(found.repeated().view(np.int64))})

    return (
        prints.select(column).mapInArrow(build, _PACKED).groupBy("block").applyInArrow(merge, f"`{column}` long")
    )


def exact_groups(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    plain = docs.select(F.col(id_).alias("id"), normalised(whole_text(text)).alias("text"))
    plain = plain.select("id", "text", F.xxhash64("text").alias("print"), F.sha2("text", 256).alias("sha"))
    narrow = stored(plain.drop("text"), "prints")
    again = stored(repeated_fingerprints(narrow, "print", narrow.count()), "repeated")
    again = small(again).withColumn("routed", F.lit(True))

    # bytes decide: texts are the grouping key
    groups = (
        plain.join(again, "print")
        .groupBy("print", "sha", "text")
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        .drop("text")
    )
    marked = narrow.join(again, "print", "left")
    alone = marked.where("routed IS NULL").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    copies = (
        marked.where("routed")
        .groupBy("id", "print", "sha")
        .agg(F.count("*").alias("n"))
        .join(groups, ["print", "sha"])
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
        .select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 1)).alias("kept"), "sha")
    )
    out = alone.unionByName(copies)
    return out.select(F.col("id").alias(id_), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the smallest id."""
    sha, n = fresh_name(docs, "sha"), fresh_name(docs, "n")
    groups = exact_groups(docs, id_, text).where("group_size > 1")
    rows = groups.groupBy(F.col(id_).alias("gone_id"), F.col("text_sha256").alias("gone_sha")).agg(
        F.max("kept").alias("stays"), F.count("*").alias("n")
    )
    # rows that go, and rows that are there several times over, id and text alike
    rows = small(stored(rows.where("NOT stays OR n > 1"), "copies"))
    with_sha = docs.withColumn(sha, F.sha2(normalised(whole_text(text)), 256))
    same = with_sha[id_].eqNullSafe(rows["gone_id"]) & (with_sha[sha] == rows["gone_sha"])
    single = with_sha.join(rows, same, "left_anti").drop(sha)
    several = rows.where("stays").withColumnRenamed("n", n)
    one = with_sha.join(several, with_sha[id_].eqNullSafe(several["gone_id"]) & (with_sha[sha] == several["gone_sha"]), "left_semi")
    return single.unionByName(one.dropDuplicates([id_, sha]).drop(sha))
