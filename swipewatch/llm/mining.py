"""Hard negatives by rotated one-bit codes.

Vectors are scaled and rounded down to whole numbers, rotated (signs, then a Hadamard transform, three times over) and
coded by the signs of their components, one bit each. A code's direction explains a part of the vector, told by
the stored alignment of code and vector; what is left is coded in the same way, ``levels`` times in all.

The product with an anchor is the sum over the levels of the code's length times its product with the anchor, which
popcounts over the anchor's bit planes give, and the product of two residuals. Cauchy-Schwarz bounds that one, and
what rounding to the planes costs, by lengths that are known: an interval that holds the product for certain. Only
rows whose interval reaches the place that counts are scored in whole numbers, so the results are those of a full
comparison.

The anchors are a stated query set, all rows are compared with them in blocks: packed rows meet packed anchors by an
equi-join on the number of the anchors' tile. Each pair of a block and a tile gives no more than the wanted number of
rows per anchor, and the best of these are found by rank, cut before the exchange.

Rows without id, label or vector, or with a component that is null or not finite, take no part. Rows alike in id, label
and components count once; others under one id each take part, and none is a positive of an anchor of its id.
Shorter vectors count as filled up with zeros. Components saturate and scores wrap around as whole numbers of 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swipewatch.llm.shared import stored, text_batches

LONG = np.int64


@dataclass(frozen=True)
class MiningPolicy:
    scale: int = 256
    positives: int = 5
    negatives: int = 10
    least: int = 30  # a negative's score is at least this share of the positive's, in hundredths
    most: int = 90
    levels: int = 4
    planes: int = 7  # bits to which an anchor's components are rounded
    block_values: int = 1 << 18  # components of the rows packed into one block
    tile_values: int = 1 << 16  # components of the anchors packed into one tile
    few_values: int = 1 << 21  # components of all anchors that may be broadcast: 16 MB
    salts: int = 64  # pieces over which the blocks of a tile are dealt beyond that


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` (a power of two wide) in another orthonormal basis, the same one wherever it is called."""
    width = x.shape[1]
    signs = np.random.default_rng(width).integers(0, 2, (3, width)) * 2.0 - 1.0
    for s in signs:
        x = x * s
        step = 1
        while step < width:
            pairs = x.reshape(len(x), -1, 2, step)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), width)
            step *= 2
        x = x / np.sqrt(width)
    return x


def _bits(positive: np.ndarray) -> np.ndarray:
    """Rows of booleans as words of 64 bits."""
    packed = np.packbits(positive, axis=1, bitorder="little")
    gap = -packed.shape[1] % 8
    return np.pad(packed, ((0, 0), (0, gap))).view("<u8")


@dataclass
class Codes:
    words: np.ndarray  # (levels, rows, words) one-bit codes
    alignment: np.ndarray  # (levels, rows) cosine of code and what it codes
    norm: np.ndarray  # (rows) length of the vector
    width: int

    @classmethod
    def of(cls, ints: np.ndarray, levels: int) -> "Codes":
        left, width = rotated(ints.astype(np.float64)), ints.shape[1]
        norm = np.sqrt((left * left).sum(1))
        words, alignment = [], []
        for _ in range(levels):
            positive = left > 0
            signs = np.where(positive, 1.0, -1.0)
            along = (left * signs).sum(1) / width
            length = np.sqrt((left * left).sum(1))
            words.append(_bits(positive))
            alignment.append(np.divide(along * np.sqrt(width), length, out=np.zeros(len(left)), where=length > 0))
            left = left - along[:, None] * signs
        return cls(np.stack(words), np.clip(np.stack(alignment), 0.0, 1.0), norm, width)

    def lengths(self) -> tuple:
        """Length of each level's coded part, and of what is left at the end (rounding added)."""
        rest, parts = self.norm, []
        for a in self.alignment:
            parts.append(rest * a)
            rest = rest * np.sqrt(np.maximum(1 - a * a, 0))
        return parts, rest + 1e-7 * self.norm


class Queries:
    """Anchors, rotated and rounded to bit planes."""

    def __init__(self, ints: np.ndarray, planes: int):
        values = rotated(ints.astype(np.float64))
        self.low = values.min(1, initial=0.0)
        span = values.max(1, initial=0.0) - self.low
        self.step = np.where(span > 0, span, 1.0) / ((1 << planes) - 1)
        rounded = np.rint((values - self.low[:, None]) / self.step[:, None]).astype(LONG)
        missed = values - self.low[:, None] - rounded * self.step[:, None]
        self.error = np.sqrt((missed * missed).sum(1))
        self.norm = np.sqrt((values * values).sum(1))
        self.total = rounded.sum(1)
        self.planes = [_bits(rounded >> p & 1 == 1) for p in range(planes)]

    def intervals(self, codes: Codes, q: slice) -> tuple:
        """Least and greatest possible product of each query of ``q`` with each coded row."""
        width, root = codes.width, np.sqrt(codes.width)
        parts, rest = codes.lengths()
        middle = np.zeros((len(self.low[q]), len(codes.norm)))
        half = np.zeros_like(middle)
        inside = None
        for words, length in zip(codes.words, parts):
            hits = np.zeros(middle.shape, np.int32)
            for p, plane in enumerate(self.planes):
                both = np.bitwise_count(words[None, :, 0] & plane[q][:, None, 0]).astype(np.int32)
                for w in range(1, words.shape[1]):
                    both += np.bitwise_count(words[None, :, w] & plane[q][:, None, w])
                hits += both << p
            ones = np.bitwise_count(words).sum(1, dtype=LONG)
            signed = self.step[q][:, None] * (2 * hits - self.total[q][:, None]) + self.low[q][:, None] * (2 * ones - width)
            inside = np.abs(signed) / root - self.error[q][:, None]  # of the anchor's length, along the last code
            middle += signed * (length / root)
            half += self.error[q][:, None] * length
        # the residual is at right angles to the last code: only the rest of the anchor meets it
        across = np.sqrt(np.maximum(self.norm[q][:, None] ** 2 - np.maximum(inside, 0.0) ** 2, 0.0))
        most = self.norm[q][:, None] * codes.norm
        half += rest * across + 1e-9 * most + 1e-6
        half[most >= 2.0**62] = np.inf
        return middle - half, middle + half


def top(order: list, groups: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group in the order of the sort keys, the first key counting most."""
    by = np.lexsort([*order[::-1], groups])
    g = groups[by]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, LONG)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return by[rank < k]


def _kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """k-th largest of each row; -inf where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _width(dims: int) -> int:
    return 1 << max(0, dims - 1).bit_length()


def participants(rows: DataFrame, id_: str, vector: str, label, p: MiningPolicy) -> DataFrame:
    """(id, mark, label, q) of the rows that take part, each once."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    made = rows.select(F.col(id_).cast("long").alias("id"), label.cast("long").alias("label"), values.alias("v"))
    made = made.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(F.forall("v", finite))
    q = F.transform("v", lambda x: F.floor(x * p.scale))
    made = made.select("id", "label", q.alias("q"))
    return made.withColumn("mark", F.xxhash64("label", "q")).dropDuplicates(["id", "mark"]).select("id", "mark", "label", "q")


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), LONG)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


_BLOCK = "block long, ids binary, marks binary, labels binary, ints binary, wide boolean, words binary, alignment binary, norm binary"
_TILE = "tile long, a_ids binary, a_marks binary, a_labels binary, a_ints binary, wanted binary"


def _narrow_ints(ints: np.ndarray) -> tuple:
    wide = bool(len(ints)) and int(np.abs(ints.astype(np.float64)).max()) >= 1 << 31
    return (ints if wide else ints.astype(np.int32)).tobytes(), wide


def _collected(batches, at_most: int):
    """Batches put together until there are ``at_most`` rows, and cut there."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        while n >= at_most:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, at_most).combine_chunks()
            held, n = whole.slice(at_most).to_batches(), n - at_most
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table.column(name).chunks)


def _blocks(rows: DataFrame, width: int, p: MiningPolicy) -> DataFrame:
    """Rows packed with their codes, stored."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for t in _collected(batches, max(1, p.block_values // width)):
            ints = _matrix(_column(t, "q"), width)
            codes = Codes.of(ints, p.levels)
            raw, wide = _narrow_ints(ints)
            plain = [_column(t, c).to_numpy().astype(LONG).tobytes() for c in ("id", "mark", "label")]
            values = [number, *plain, raw, wide, *(x.tobytes() for x in (codes.words, codes.alignment, codes.norm))]
            yield pa.RecordBatch.from_pylist([dict(zip(_names(_BLOCK), values))], schema=_arrow(_BLOCK))
            number += 1

    return stored(rows.mapInArrow(run, _BLOCK), "blocks")


def _names(schema: str) -> list:
    return [x.split()[0] for x in schema.split(", ")]


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _tiles(anchors: DataFrame, width: int, count: int, p: MiningPolicy, k: int = 0) -> tuple:
    """(tiles of packed anchors, stored; their number). ``wanted``: scores of up to ``k`` positives, if there are any."""
    size = max(1, p.tile_values // width)
    n = -(-count // size)

    def run(batches):
        number = TaskContext.get().partitionId()
        for t in _collected(batches, 1 << 30):
            plain = [_column(t, c).to_numpy().astype(LONG).tobytes() for c in ("id", "mark", "label")]
            wanted = np.full((t.num_rows, k), np.iinfo(LONG).min)
            if k:
                for row, scores in enumerate(_column(t, "scores").to_pylist()):
                    wanted[row, : len(scores)] = scores
            values = [number, *plain, _matrix(_column(t, "q"), width).tobytes(), wanted.tobytes()]
            yield pa.RecordBatch.from_pylist([dict(zip(_names(_TILE), values))], schema=_arrow(_TILE))

    dealt = anchors.repartition(max(1, n), "id", "mark")
    return stored(dealt.mapInArrow(run, _TILE), "tiles"), max(1, n)


def _each(n: int) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _met(blocks: DataFrame, tiles: DataFrame, n: int, count: int, width: int, p: MiningPolicy) -> DataFrame:
    """Each block with each tile."""
    asked = blocks.withColumn("tile", _each(n))
    if count * width <= p.few_values:
        return asked.join(F.broadcast(tiles), "tile")
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(p.salts)))
    salted = tiles.withColumn("salt", _each(p.salts))
    return asked.join(salted, ["tile", "salt"])


class _Pair:
    """A block and a tile, unpacked."""

    def __init__(self, row: dict, width: int, p: MiningPolicy):
        whole = lambda c, kind=LONG: np.frombuffer(row[c], kind)
        self.ids, self.marks, self.labels = whole("ids"), whole("marks"), whole("labels")
        self.ints = whole("ints", LONG if row["wide"] else np.int32).reshape(-1, width)
        n = len(self.ids)
        words = whole("words", "<u8").reshape(p.levels, n, -1)
        self.codes = Codes(words, whole("alignment", np.float64).reshape(p.levels, n), whole("norm", np.float64), width)
        self.a_ids, self.a_marks, self.a_labels = whole("a_ids"), whole("a_marks"), whole("a_labels")
        self.a_ints = whole("a_ints").reshape(-1, width)
        self.wanted = whole("wanted").reshape(len(self.a_ids), -1)
        self.queries = Queries(self.a_ints, p.planes)

    def parts(self, cells: int = 1 << 18):
        step = max(1, cells // max(1, len(self.ids)))
        for k in range(0, len(self.a_ids), step):
            q = slice(k, min(k + step, len(self.a_ids)))
            yield q, *self.queries.intervals(self.codes, q)

    def scores(self, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), LONG)
        for k in range(0, len(a), 1 << 15):
            s = slice(k, k + (1 << 15))
            out[s] = (self.a_ints[a[s]] * self.ints[r[s]].astype(LONG)).sum(1)
        return out


def _best_positives(pair: _Pair, p: MiningPolicy) -> list:
    found = []
    for q, low, high in pair.parts():
        fit = (pair.labels == pair.a_labels[q][:, None]) & (pair.ids != pair.a_ids[q][:, None])
        reach = _kth_largest(np.where(fit, low, -np.inf), p.positives)
        a, r = np.nonzero(fit & (high >= reach[:, None]))
        a += q.start
        score = pair.scores(a, r)
        keep = top([~score, pair.ids[r], pair.marks[r]], a, p.positives)
        a, r = a[keep], r[keep]
        found.append([pair.a_ids[a], pair.a_marks[a], np.zeros(len(a), LONG), pair.ids[r], pair.marks[r], score[keep]])
    return found


def _best_negatives(pair: _Pair, p: MiningPolicy) -> list:
    found, none = [], np.iinfo(LONG).min
    for q, low, high in pair.parts():
        fit = pair.labels != pair.a_labels[q][:, None]
        asked = pair.wanted[q].T
        reached = np.zeros(fit.shape, bool)
        for scores in asked:
            there = (scores != none)[:, None]
            least, most = (np.where(scores == none, 0.0, scores * (x / 100.0))[:, None] for x in (p.least, p.most))
            slack = 1e-9 * np.abs(most)
            certain = there & fit & (low >= least + slack) & (high <= most - slack)
            tenth = _kth_largest(np.where(certain, low, -np.inf), p.negatives)[:, None]
            reached |= there & fit & (high >= np.maximum(least - slack, tenth)) & (low <= most + slack)
        a, r = np.nonzero(reached)
        a += q.start
        score = pair.scores(a, r)
        for j in range(pair.wanted.shape[1]):
            of = pair.wanted[a, j]
            # whole numbers decide; those that could overflow are compared as Python's
            if len(score) and max(np.abs(score.astype(float)).max(), np.abs(np.where(of == none, 0, of).astype(float)).max()) > 2.0**55:
                inside = np.array([o != none and p.least * o <= 100 * s <= p.most * o for o, s in zip(of.tolist(), score.tolist())], bool)
            else:
                inside = (of != none) & (p.least * of <= 100 * score) & (100 * score <= p.most * of)
            at = np.flatnonzero(inside)
            keep = at[top([~score[at], pair.ids[r[at]], pair.marks[r[at]]], a[at], p.negatives)]
            x, y = a[keep], r[keep]
            found.append([pair.a_ids[x], pair.a_marks[x], np.full(len(x), j, LONG), pair.ids[y], pair.marks[y], score[keep]])
    return found


_FOUND = ["a_id", "a_mark", "place", "id", "mark", "score"]


def _searched(met: DataFrame, search, k: int, width: int, p: MiningPolicy) -> DataFrame:
    """The best ``k`` rows (``rank`` from 1) for each anchor and place."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                found = search(_Pair(row, width, p), p)
                columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, LONG)] * len(_FOUND)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _FOUND)

    names = [c for c in met.columns if c not in ("block", "tile", "salt")]
    hits = text_batches(met).select(*names).mapInArrow(run, ", ".join(f"{c} long" for c in _FOUND))
    order = Window.partitionBy("a_id", "a_mark", "place").orderBy(F.desc("score"), "id", "mark")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(
    rows: DataFrame,
    id_: str = "vec_id",
    vector: str = "embedding",
    label: str | F.Column = "label",
    anchor: F.Column | None = None,
    p: MiningPolicy = MiningPolicy(),
) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a condition on the column ``id`` (default: all rows are anchors). Higher scores come first, ties by id.
    """
    taken = participants(rows, id_, vector, F.col(label) if isinstance(label, str) else label, p)
    taken = stored(taken, "vectors")
    anchors = taken if anchor is None else taken.where(anchor)
    width = _width(taken.agg(F.max(F.size("q"))).first()[0] or 1)
    count = anchors.count()
    blocks = _blocks(taken, width, p)
    first = _searched(_met(blocks, *_tiles(anchors, width, count, p), count, width, p), _best_positives, p.positives, width, p)
    first = stored(first.select("a_id", "a_mark", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))), lambda x: x["positive_score"])
    scores = first.groupBy(F.col("a_id").alias("id"), F.col("a_mark").alias("mark")).agg(ordered.alias("scores"))
    asking = anchors.join(scores, ["id", "mark"])
    second = _searched(
        _met(blocks, *_tiles(asking, width, count, p, p.positives), count, width, p), _best_negatives, p.negatives, width, p
    )
    second = second.withColumnsRenamed({"id": "negative_id", "score": "negative_score", "rank": "n"}).drop("mark")
    second = second.withColumn("rank", (F.col("place") + 1).cast("int")).drop("place")
    return second.join(first, ["a_id", "a_mark", "rank"]).select(
        F.col("a_id").alias("anchor_id"), "positive_id", F.col("n").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
