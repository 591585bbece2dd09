"""n-gram scores with deleted interpolation.

Maximum-likelihood estimates of the orders 0 (uniform over the vocabulary and one unknown word) to
``order`` are mixed; the weights depend on how often the context was seen (powers of two). Weights
come from expectation-maximisation on counts held out from the training part: one training document
in ``dev_parts`` is left out of the counts that the weights are learned on, and counted afterwards.

1. Each task turns its texts into chunks of about ``chunk_tokens`` tokens: numbers into a vocabulary
   of hashed words. A chunk's documents have one role: counted, held out for the weights, or scored
   only.
2. A chunk asks for the counts of its different n-grams, in packed blocks dealt by ranges of the
   n-gram's hash. A range holds about ``range_keys`` of these requests whatever the corpus, and an
   n-gram that is everywhere is one request per chunk; so no range is large because of one n-gram.
3. Each range adds up the counts and answers every chunk, again in packed blocks.
4. Chunks and answers meet: those held out give a histogram of likelihood ratios (its size is bounded
   by its resolution) for the weights, then all give their documents' scores.

n-grams are compared by 64-bit hashes. Null and empty texts are the end token alone. A null id counts
as the empty text when roles are dealt. Repeated rows are documents like any other. Without training
tokens all weight is on the uniform estimate.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm.shared import id_bucket, stored, text_batches, whole_text

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = b"\xff\xfe"  # the end token among words; never part of UTF-8
_END_HASH = np.uint64(xxhash.xxh64_intdigest(_END, 42))
COUNTED, DEV, SCORED = 0, 1, 2
_NOTHING = -(1 << 14)  # in the histogram: an estimate of zero


@dataclass(frozen=True)
class LmPolicy:
    order: int = 2
    chunk_tokens: int = 1_000_000
    range_keys: int = 1_500_000
    dev_parts: int = 10
    steps: int = 8  # of the histogram, per doubling
    rounds: int = 100
    pseudo: float = 1.0  # tokens added to each weight of each bucket


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of equal place, compressed."""
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unsqueezed(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()


def mixed(context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of its first words and of its last one."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(29)
    x = (x + last) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(words: np.ndarray, order: int) -> list:
    """Hashes of the n-grams that end at each place, n = 1 to ``order``; before a text stands an end token."""
    out = [words]
    for _ in range(1, order):
        out.append(mixed(np.r_[_END_HASH, out[-1][:-1]], words))
    return out


class _Chunk:
    def __init__(self):
        self.ids, self.codes, self.tokens, self.known = [], [], 0, {_END: 0}

    def add(self, ids: list, texts: list) -> None:
        texts = [t.decode("utf-8", "replace").encode() if b"\xff" in t else t for t in texts]
        words = b"".join([x for t in texts for x in (t, b" " + _END + b" ")]).translate(_LOWER).split()
        codes = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(codes < 0).tolist()
        if missing:
            new = dict.fromkeys([words[i] for i in missing])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            codes[missing] = [self.known[words[i]] for i in missing]
        self.ids += ids
        self.codes.append(codes)
        self.tokens += len(codes)

    def row(self, number: int, role: int) -> tuple:
        codes = np.concatenate(self.codes)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.known, repeat(42)), np.uint64, len(self.known))
        order = np.argsort(-np.bincount(codes, minlength=len(hashes)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return number, role, self.ids, squeezed(rank[codes]), hashes[order].tobytes(), len(codes), len(hashes)


_CHUNK = ["chunk", "role", "ids", "codes", "words", "n_tokens", "n_words"]


def chunks(docs: DataFrame, id_: str, text: str, held_out, p: LmPolicy) -> DataFrame:
    """Texts as packed chunks; one row each."""
    dev = F.pmod(F.xxhash64(F.lit("dev"), F.col("id").cast("string")), F.lit(p.dev_parts)) == 0
    narrow = text_batches(docs).select(F.col(id_).alias("id"), held_out.alias("out"), whole_text(text).alias("text")).select(
        "id", F.when(F.col("out"), SCORED).when(dev, DEV).otherwise(COUNTED).alias("role"), "text"
    )
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches):
        open_, number, id_type = {}, TaskContext.get().partitionId() << 32, None

        def batch_of(role):
            nonlocal number
            row = open_.pop(role).row(number, role)
            number += 1
            kinds = [pa.int64(), pa.int32(), pa.list_(id_type), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], _CHUNK)

        for b in batches:
            id_type = b.schema.field(0).type
            ids, roles = b.column(0).to_pylist(), b.column(1).to_numpy()
            texts = b.column(2).cast(pa.binary()).to_pylist()
            for role in np.unique(roles).tolist():
                mine = np.flatnonzero(roles == role).tolist()
                for k in range(0, len(mine), 256):
                    part = mine[k : k + 256]
                    chunk = open_.setdefault(role, _Chunk())
                    chunk.add([ids[i] for i in part], [texts[i] for i in part])
                    if chunk.tokens >= p.chunk_tokens:
                        yield batch_of(role)
        for role in sorted(open_):
            yield batch_of(role)

    schema = f"chunk long, role int, ids array<{kind}>, codes binary, words binary, n_tokens long, n_words long"
    return stored(narrow.mapInArrow(run, schema), "chunks")


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


_ASKED = "level int, place int, chunk long, role int, keys binary, counts binary"


def requests(rows: DataFrame, ranges: list) -> DataFrame:
    """Each chunk's different n-grams with their counts in it, in order, a block per range."""
    names = [c.split()[0] for c in _ASKED.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                vocabulary, codes = np.frombuffer(row["words"], np.uint64), unsqueezed(row["codes"], np.uint32)
                for level, hashes in enumerate(ngrams(vocabulary[codes], len(ranges))):
                    keys, counts = np.unique(hashes, return_counts=True)
                    place = _range_of(keys, ranges[level])
                    cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
                    out = [
                        (
                            level, int(place[i]), row["chunk"], row["role"],
                            squeezed(np.diff(keys[i:j], prepend=np.uint64(0))), squeezed(counts[i:j].astype(np.uint32)),
                        )
                        for i, j in zip(cuts[:-1], cuts[1:])
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.select("chunk", "role", "codes", "words").mapInArrow(run, _ASKED)


_ANSWER = "chunk long, role int, level int, place int, part binary, whole binary, types_part long, tokens_part long, types_whole long, tokens_whole long"


def answers(asked: DataFrame) -> DataFrame:
    """Counts of all requested n-grams: in the counted documents (part), and with those held out for the weights (whole).

    A row with chunk -1 per range says how many different n-grams and how many in all it has.
    """
    names = [c.split()[0] for c in _ANSWER.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()] + [pa.int64()] * 4

    def run(table):
        level, place = table.column("level")[0].as_py(), table.column("place")[0].as_py()
        order = np.argsort(table.column("chunk").to_numpy())  # the same result whatever the order of arrival
        table = table.take(pa.array(order))
        keys = [np.cumsum(unsqueezed(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        counts = [unsqueezed(x, np.uint32) for x in table.column("counts").to_pylist()]
        sizes = [len(k) for k in keys]
        role = np.repeat(table.column("role").to_numpy(), sizes)
        values, where = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate(counts).astype(np.float64)  # whole below 2 ** 53
        part = np.bincount(where, counts * (role == COUNTED), len(values)).astype(np.uint64)
        whole = np.bincount(where, counts * (role != SCORED), len(values)).astype(np.uint64)
        ends = np.r_[0, np.cumsum(sizes)]
        rows = [
            (chunk, of, level, place, squeezed(part[where[a:b]]), squeezed(whole[where[a:b]]), 0, 0, 0, 0)
            for chunk, of, a, b in zip(*(table.column(c).to_pylist() for c in ("chunk", "role")), ends[:-1], ends[1:])
        ]
        rows.append((-1, -1, level, place, b"", b"", int((part > 0).sum()), int(part.sum()), int((whole > 0).sum()), int(whole.sum())))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return stored(asked.groupBy("level", "place").applyInArrow(run, _ANSWER), "answers")


def _counts(chunk: pa.Table, found: pa.Table, order: int, column: str) -> tuple:
    """(words, per level the count of the n-gram that ends at each place and of its context)."""
    vocabulary = np.frombuffer(chunk.column("words")[0].as_py(), np.uint64)
    words = vocabulary[unsqueezed(chunk.column("codes")[0].as_py(), np.uint32)]
    found = found.sort_by([("level", "ascending"), ("place", "ascending")])
    level, blocks = found.column("level").to_numpy(), found.column(column).to_pylist()
    counts, contexts = [], []
    after_end = np.r_[True, words[:-1] == _END_HASH]
    for n, hashes in enumerate(ngrams(words, order)):
        mine = np.concatenate([unsqueezed(blocks[i], np.uint64) for i in np.flatnonzero(level == n)])
        _, where = np.unique(hashes, return_inverse=True)
        counts.append(mine[where].astype(np.float64))
        if n:
            before = np.r_[0.0, counts[n - 1][:-1]]
            if n == 1:
                before[0] = counts[0][np.argmax(words == _END_HASH)]
            else:
                before[after_end] = 0.0  # a context doesn't reach beyond its text
            contexts.append(before)
    return words, counts, contexts


def _estimates(counts: list, contexts: list, types: int, tokens: int) -> tuple:
    """(bucket of each place's contexts, estimates of order 1 and up as multiples of the uniform one)."""
    bucket = np.zeros(len(counts[0]), np.int64)
    ratios = [counts[0] * ((types + 1) / max(tokens, 1))]
    for c, context in zip(counts[1:], contexts):
        bucket = bucket * 64 + np.ceil(np.log2(context + 1)).astype(np.int64)
        ratios.append(np.where(context > 0, c / np.maximum(context, 1) * (types + 1), 0.0))
    return bucket, ratios


def learned(cells: list, order: int, p: LmPolicy) -> dict:
    """Bucket -> weights of the orders 0 up, by expectation-maximisation over (bucket, exponents, tokens)."""
    by_bucket = {}
    for bucket, exponents, n in cells:
        by_bucket.setdefault(bucket, []).append((exponents, n))
    out = {}
    for bucket, rows in by_bucket.items():
        e = np.array([r[0] for r in rows], float)
        n = np.array([r[1] for r in rows], float)
        like = np.c_[np.ones(len(rows)), np.where(e == _NOTHING, 0.0, 2.0 ** (e / p.steps))]
        w = np.full(order + 1, 1 / (order + 1))
        for _ in range(p.rounds):
            share = like * w
            got = (share / share.sum(1, keepdims=True) * n[:, None]).sum(0) + p.pseudo
            w = got / got.sum()
        out[bucket] = w
    return out


def scored(docs: DataFrame, held_out=None, id_: str = "doc_id", text: str = "text", p: LmPolicy = LmPolicy()) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a boolean column: documents that are scored but not learned from.
    """
    held_out = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    rows = chunks(docs, id_, text, held_out, p)
    size = rows.agg(F.sum("n_tokens").alias("t"), F.sum("n_words").alias("w")).first()
    ranges = [max(1, -(-(n or 0) // p.range_keys)) for n in [size["w"]] + [size["t"]] * (p.order - 1)]
    told = answers(requests(rows, ranges))
    sums = ["types_part", "tokens_part", "types_whole", "tokens_whole"]
    total = told.where("chunk < 0 AND level = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).first()
    replies = told.where("chunk >= 0").select("chunk", "role", "level", "place", "part", "whole")
    order, steps = p.order, p.steps
    types_part, tokens_part, types_whole, tokens_whole = (total[c] for c in sums)

    def ratios(chunk, found):
        if not chunk.num_rows:
            return _empty
        _, counts, contexts = _counts(chunk, found, order, "part")
        bucket, r = _estimates(counts, contexts, types_part, tokens_part)
        with np.errstate(divide="ignore"):
            e = [np.where(x > 0, np.round(np.log2(np.maximum(x, 1e-300)) * steps), _NOTHING).astype(np.int64) for x in r]
        cells, n = np.unique(np.stack([bucket, *e], 1), axis=0, return_counts=True)
        return pa.table(
            [pa.array(cells[:, 0]), pa.array(list(cells[:, 1:]), pa.list_(pa.int64())), pa.array(n)], ["bucket", "e", "n"]
        )

    _empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.int64())], ["bucket", "e", "n"])
    of_chunk = replies.groupBy("chunk")
    dev = rows.where(F.col("role") == DEV).groupBy("chunk")
    cells = dev.cogroup(replies.where(F.col("role") == DEV).groupBy("chunk")).applyInArrow(ratios, "bucket long, e array<long>, n long")
    cells = cells.groupBy("bucket", "e").agg(F.sum("n").alias("n"))
    weights = learned([tuple(r) for r in cells.collect()], order, p) if tokens_part else {}

    known = sorted(weights)
    if known:
        matrix = np.array([weights[k] for k in known])
    else:
        known, matrix = [0], np.array([[1.0] + [0.0] * order] if not tokens_whole else [[1 / (order + 1)] * (order + 1)])
    known_buckets = np.array(known)
    kind = rows.schema["ids"].dataType.elementType.simpleString()
    columns = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(chunk, found):
        if not chunk.num_rows:
            raise ValueError("counts without a chunk")
        words, counts, contexts = _counts(chunk, found, order, "whole")
        bucket, r = _estimates(counts, contexts, types_whole, tokens_whole)
        w = matrix[np.maximum(np.searchsorted(known_buckets, bucket, side="right") - 1, 0)]
        for k, context in enumerate(contexts):
            w[:, k + 2] *= context > 0  # an unseen context says nothing
        w /= w.sum(1, keepdims=True)
        value = w[:, 0] + sum(w[:, k + 1] * x for k, x in enumerate(r))
        logs = np.log10(value / (types_whole + 1))
        base = np.log10((counts[0] + 0.5) / (tokens_whole + 0.5 * (types_whole + 1)))
        ends = np.flatnonzero(words == _END_HASH)
        begins = np.r_[0, ends[:-1] + 1]
        sums_of = lambda x: np.add.reduceat(x, begins)
        ids = chunk.column("ids").combine_chunks().flatten()
        n = len(ends)
        made = [
            np.full(n, chunk.column("role")[0].as_py() == SCORED),
            ends - begins + 1,
            sums_of((counts[0] > 0).astype(np.int64)),
            np.full(n, tokens_whole, np.int64),
            sums_of(base),
            sums_of(logs),
        ]
        return pa.table([ids, *map(pa.array, made)], ["id", *columns])

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = rows.select("chunk", "role", "ids", "codes", "words").groupBy("chunk").cogroup(of_chunk).applyInArrow(score, schema)
    return out.withColumnRenamed("id", id_)


def held_out_by_id(id_: str = "doc_id"):
    """Documents that the query scores but doesn't learn from: crc32 of the id as text leaves 1 by 5."""
    return id_bucket(id_, 5) == 1
