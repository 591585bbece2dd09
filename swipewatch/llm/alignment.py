"""Alignment of two tokenizers over the same bytes by products of sparse incidence matrices.

Tokens of A and of B are rows of incidence matrices in compressed form (``csr.py``). Token-byte matrices
multiplied row by row (Gustavson) give the overlap links, A times the transposed B: how many bytes an A
token and a B token share. Byte offsets where tokens of both end cut them into groups; token-group
matrices multiplied likewise give the shared-group links: all A-B pairs of one group.

1. Each task turns its texts into chunks of about ``chunk_links`` different id pairs of documents, with
   the chunk's different pairs and in how many of its documents each is linked.
2. Pairs are counted over the corpus (map-side combined), and each A id's highest count is found.
3. A chunk asks for the counts of its different pairs by an equi-join, so that a pair that is everywhere
   is one row per chunk, and gives its documents' sums.

Null and empty texts, bytes that are no UTF-8, and texts
whose joined token bytes differ from a space and the text have no tokens: zeros, empty digest. Repeated rows
are documents like any other; a null id is an id.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm.csr import Csr, spread
from swipewatch.llm.language_model import squeezed, unsqueezed
from swipewatch.llm.shared import stored, text_batches, whole_text

_B_BITS = 16  # of a pair's number; the rest is the A id
_PAIR_BITS = 40
_DIGITS = 6


@dataclass(frozen=True)
class AlignPolicy:
    byte_vocab: str | None = None  # files; default: those of the installed public tokenizers
    piece_model: str | None = None
    chunk_links: int = 1_000_000
    batch_bytes: int = 1 << 19  # of texts that are aligned at once


class Tokens:
    """A tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, encode, token_bytes: list):
        self.encode = encode  # texts that begin with a space -> one array of ids each
        self.sizes = np.array([len(b) for b in token_bytes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(token_bytes), np.uint8)

    def tokens(self, texts: list, raw: list) -> tuple:
        """(ids of all texts, number of tokens of each text, whether the tokens' bytes are those of ``raw``)."""
        encoded = self.encode(texts)
        per_text = np.array([len(x) for x in encoded], np.int64)
        ids = np.concatenate([np.zeros(0, np.int64), *encoded]).astype(np.int64)
        sizes = self.sizes[ids]
        ends, tokens = np.cumsum(per_text), np.r_[0, np.cumsum(sizes)]
        long = np.diff(tokens[np.r_[0, ends]]) == [len(x) for x in raw]
        # bytes are compared where the lengths agree
        same = np.repeat(long, per_text)
        made = self.letters[spread(self.starts[ids[same]], sizes[same])]
        want = np.frombuffer(b"".join([x for x, ok in zip(raw, long.tolist()) if ok]), np.uint8)
        wrong = np.r_[0, np.cumsum(made != want)]
        places = np.cumsum([len(x) if ok else 0 for x, ok in zip(raw, long.tolist())], dtype=np.int64)
        return ids, per_text, long & (np.diff(wrong[np.r_[0, places]]) == 0)


def _byte_symbols() -> list:
    """The symbol of each byte in byte-level vocabularies: itself if printable, else the next of those from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def tokenizers_of(p: AlignPolicy) -> tuple:
    """A and B, once per worker."""
    import json

    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(p.byte_vocab or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        made = json.load(f)
    back = {s: b for b, s in enumerate(_byte_symbols())}
    specials = {x["content"] for x in made.get("added_tokens", [])}
    vocab = {s: n for s, n in made["model"]["vocab"].items() if s not in specials}
    ranks = {bytes(back[c] for c in s): n for s, n in vocab.items()}
    table = [b""] * (max(ranks.values()) + 1)
    for b, n in ranks.items():
        table[n] = b
    byte_level = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    model = sentencepiece.SentencePieceProcessor(model_file=p.piece_model or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [model.id_to_piece(n) for n in range(model.get_piece_size())]
    if len(pieces) > 1 << _B_BITS:
        raise ValueError(f"more than {1 << _B_BITS} pieces")
    b_table = []
    for n, x in enumerate(pieces):
        of_byte = model.is_byte(n)
        b_table.append(bytes([int(x[3:5], 16)]) if of_byte else x.replace("▁", " ").encode())

    a = Tokens(lambda xs: [byte_level.encode_to_numpy(x, disallowed_special=()) for x in xs], table)
    # the model puts a space before what it encodes
    b = Tokens(lambda xs: [np.array(x, np.int64) for x in model.encode([x[1:] for x in xs], num_threads=1)], b_table)
    return a, b


@functools.cache
def _spelled(width: int) -> tuple:
    """(digits and separator, which are shown) of numbers by separator: '%' stands where the separator goes."""
    numbers = np.arange(width)
    digits = (numbers[:, None] // 10 ** np.arange(_DIGITS - 2, -1, -1)) % 10
    shown = np.ones((width, _DIGITS), bool)
    shown[:, : _DIGITS - 1] = np.maximum.accumulate(digits > 0, axis=1)
    shown[:, _DIGITS - 2] = True
    text = np.full((width, _DIGITS), ord("%"), np.uint8)
    text[:, : _DIGITS - 1] = digits + ord("0")
    return text, shown


class Aligned:
    """The alignment of several texts at once; texts follow one another without touching."""

    def __init__(self, raw: list, p: AlignPolicy):
        self.n = len(raw)
        texts, at = [], []
        for k, b in enumerate(raw):
            try:
                t = b.decode() if b else ""
            except UnicodeDecodeError:
                t = ""
            if t:
                texts.append(" " + t)
                at.append(k)
        tokenizer_a, tokenizer_b = tokenizers_of(p)
        bytes_ = [t.encode() for t in texts]
        a, per_a, right_a = tokenizer_a.tokens(texts, bytes_)
        b, per_b, right_b = tokenizer_b.tokens(texts, bytes_)
        good = right_a & right_b
        keep_a, keep_b = np.repeat(good, per_a), np.repeat(good, per_b)
        at = np.array(at, np.int64)
        self.a, self.b = a[keep_a], b[keep_b]
        self.doc_a, self.doc_b = np.repeat(at, per_a)[keep_a], np.repeat(at, per_b)[keep_b]
        self.a_ends, self.b_ends = np.cumsum(tokenizer_a.sizes[self.a]), np.cumsum(tokenizer_b.sizes[self.b])
        total = int(self.a_ends[-1]) if len(self.a_ends) else 0
        marks = np.zeros(total + 1, bool)
        marks[self.a_ends] = True
        self.cut_by = np.flatnonzero(marks[self.b_ends])  # B tokens that end a group
        self.cuts = self.b_ends[self.cut_by]
        self.total = total
        marks[:] = False
        marks[self.cuts] = True
        before = np.cumsum(marks, dtype=np.int32) - marks  # groups that end before a place
        self.group_a, self.group_b = before[self.a_ends].astype(np.int64), before[self.b_ends].astype(np.int64)

    def overlaps(self) -> Csr:
        """A tokens by B tokens: bytes that they share."""
        a, b = Csr.of_runs(self.a_ends, self.total), Csr.of_runs(self.b_ends, self.total)
        return a.times(b.transposed())

    def shared_groups(self) -> Csr:
        """A tokens by B tokens: whether they are in one group."""
        groups = len(self.cuts)
        return Csr.of_labels(self.group_a, groups).times(Csr.of_labels(self.group_b, groups).transposed())

    def written_groups(self) -> list:
        """``a1,a2|b1;a3|b2,b3`` of each text, as bytes."""
        groups = len(self.cuts)
        first_a, first_b = (np.r_[0, np.cumsum(np.bincount(g, minlength=groups))] for g in (self.group_a, self.group_b))
        # a group's A tokens, then its B tokens
        place_a = np.arange(len(self.a)) + first_b[self.group_a]
        place_b = np.arange(len(self.b)) + first_a[self.group_b + 1]
        text, shown = _spelled(1 << 17)
        size = len(self.a) + len(self.b)
        ids, ends = np.zeros(size, np.int64), np.full(size, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        ends[place_a[first_a[1:] - 1]] = ord("|")
        ends[place_b[first_b[1:] - 1]] = ord(";")
        letters, seen = text[ids], shown[ids]
        letters[:, -1] = ends
        flat = letters[seen].tobytes()
        lengths = seen.sum(1)
        docs = np.zeros(size, np.int64)
        docs[place_a], docs[place_b] = self.doc_a, self.doc_b
        per_doc = np.bincount(docs, weights=lengths, minlength=self.n).astype(np.int64)
        stops = np.cumsum(per_doc)
        return [flat[e - n : e - 1] if n else b"" for e, n in zip(stops.tolist(), per_doc.tolist())]

    def per_text(self, docs: np.ndarray) -> np.ndarray:
        return np.bincount(docs, minlength=self.n)


_STATS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]


class _Chunk:
    def __init__(self, kind):
        self.kind = kind
        self.ids, self.digests, self.stats, self.ends, self.pairs, self.times, self.held = [], [], [], [], [], [], 0

    def add(self, ids: pa.Array, made: Aligned) -> None:
        linked = made.shared_groups()
        rows = linked.rows()
        pair = (made.a[rows].astype(np.int64) << _B_BITS) | made.b[linked.indices]
        doc = made.doc_a[rows]
        both = np.sort(doc << _PAIR_BITS | pair)
        pair, doc = both & ((1 << _PAIR_BITS) - 1), both >> _PAIR_BITS
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, int)
        over = made.overlaps()
        stats = [
            made.per_text(made.doc_a),
            made.per_text(made.doc_b),
            made.per_text(made.doc_b[made.cut_by]),
            made.per_text(doc),
            made.per_text(made.doc_a[over.rows()]),
        ]
        self.ids.append(ids)
        self.digests += [hashlib.sha256(x).hexdigest() if x else "" for x in made.written_groups()]
        self.stats.append(np.array(stats, np.int64))
        self.ends.append(self.held + np.cumsum(np.bincount(doc[first], minlength=made.n)))
        self.pairs.append(pair[first])
        self.times.append(np.diff(np.r_[first, len(pair)]).astype(np.uint32))
        self.held += len(first)

    def row(self, number: int) -> pa.RecordBatch:
        pairs = np.concatenate(self.pairs)
        different, which, docs = np.unique(pairs, return_inverse=True, return_counts=True)
        packed = [
            np.concatenate(self.stats, axis=1).ravel(),
            np.concatenate(self.ends).astype(np.int64),
            which.astype(np.uint32),
            np.concatenate(self.times),
        ]
        one = [
            pa.array([number], pa.int64()),
            pa.array([pa.concat_arrays(self.ids).to_pylist()], pa.list_(self.kind)),
            pa.array([self.digests], pa.list_(pa.string())),
            *[pa.array([squeezed(x)], pa.binary()) for x in packed],
            pa.ListArray.from_arrays(pa.array([0, len(different)], pa.int32()), pa.array(different)),
            pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), pa.array(docs.astype(np.int64))),
        ]
        return pa.RecordBatch.from_arrays(one, _CHUNK)


_CHUNK = ["chunk", "ids", "digests", "stats", "ends", "which", "times", "pairs", "docs"]


def chunks(docs: DataFrame, id_: str, text: str, p: AlignPolicy) -> DataFrame:
    """Texts as packed chunks, one row each: documents' sums and pairs, the chunk's different ``pairs`` and their ``docs``."""
    narrow = text_batches(docs).select(F.col(id_).alias("id"), whole_text(text).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches):
        number, chunk = TaskContext.get().partitionId() << 32, None
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(1).cast(pa.binary())
            # texts by what number of whole batches is before their end
            turn = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // p.batch_bytes
            cuts = np.flatnonzero(np.r_[True, turn[1:] != turn[:-1], True]).tolist()
            for first, end in zip(cuts[:-1], cuts[1:]):
                chunk = chunk or _Chunk(b.column(0).type)
                chunk.add(b.column(0).slice(first, end - first), Aligned(texts.slice(first, end - first).to_pylist(), p))
                if chunk.held >= p.chunk_links or len(chunk.digests) >= p.chunk_links:
                    yield chunk.row(number)
                    number, chunk = number + 1, None
        if chunk:
            yield chunk.row(number)

    schema = (
        f"chunk long, ids array<{kind}>, digests array<string>, stats binary, ends binary, which binary,"
        " times binary, pairs array<long>, docs array<long>"
    )
    return narrow.mapInArrow(run, schema)


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, count, best), stored: documents that hold the pair linked; whether none of its A id's pairs has more."""
    per_chunk = made.select(F.inline(F.arrays_zip("pairs", "docs")))
    counts = stored(per_chunk.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("count")), "pairs")
    a_id = F.shiftright("pair", _B_BITS)
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("most"))
    joined = counts.withColumn("a_id", a_id).join(most, "a_id")
    return stored(joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "counted")


def aligned(docs: DataFrame, id_: str = "doc_id", text: str = "text", p: AlignPolicy = AlignPolicy()) -> DataFrame:
    """One row per row of ``docs``: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_overlaps`` (pairs that share
    bytes), ``n_best``, ``count_sum``, ``groups_sha256``."""
    made = stored(chunks(docs, id_, text, p), "chunks")
    counted = pair_counts(made)
    asked = made.select("chunk", F.explode("pairs").alias("pair"))
    answers = asked.join(counted, "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", "count", "best")).alias("found"))
    told = made.drop("pairs", "docs").join(answers, "chunk", "left")
    kind = docs.schema[id_].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k] for c in ("ids", "digests", "stats", "ends", "which", "times", "found")}
                ends = unsqueezed(row["ends"].as_py(), np.int64)
                which, times = (unsqueezed(row[c].as_py(), np.uint32) for c in ("which", "times"))
                stats = unsqueezed(row["stats"].as_py(), np.int64).reshape(len(_STATS), -1)
                if row["found"].is_valid:
                    found = row["found"].values
                    pair, count, best = (found.field(c).to_numpy(zero_copy_only=False) for c in ("pair", "count", "best"))
                    order = np.argsort(pair)
                    # the chunk numbers its pairs in their order
                    of_count, of_best = count[order][which] * times, best[order][which] * times.astype(np.int64)
                else:
                    of_count = of_best = np.zeros(len(which), np.int64)
                sums = [np.diff(np.r_[0, np.cumsum(x, dtype=np.int64)][np.r_[0, ends]]) for x in (of_best, of_count)]
                columns = [row["ids"].values, *map(pa.array, stats), *map(pa.array, sums), row["digests"].values]
                yield pa.RecordBatch.from_arrays(columns, ["id", *_STATS, "n_best", "count_sum", "groups_sha256"])

    longs = ", ".join(f"{c} long" for c in [*_STATS, "n_best", "count_sum"])
    out = told.select("ids", "digests", "stats", "ends", "which", "times", "found").mapInArrow(
        run, f"id {kind}, {longs}, groups_sha256 string"
    )
    return out.withColumnRenamed("id", id_)


def token_links(docs: DataFrame, id_: str = "doc_id", text: str = "text", p: AlignPolicy = AlignPolicy()) -> DataFrame:
    """One row per row of ``docs``: id, token ids ``a`` and ``b``, their byte ends in a space and the text, ``group_ends``,
    ``overlaps`` (place in ``a``, place in ``b``, shared bytes)."""
    narrow = text_batches(docs).select(F.col(id_).alias("id"), whole_text(text).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    names = ["id", "a", "b", "a_ends", "b_ends", "group_ends", "overlaps"]

    def run(batches):
        for b in batches:
            for id_value, raw in zip(b.column(0), b.column(1).cast(pa.binary()).to_pylist()):
                made = Aligned([raw], p)
                over = made.overlaps()
                lists = [made.a.astype(np.int64), made.b.astype(np.int64), made.a_ends, made.b_ends, made.cuts]
                links = np.stack([over.rows(), over.indices, over.values], axis=1).tolist()
                columns = [pa.array([id_value.as_py()], b.column(0).type), *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in lists]]
                struct = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("bytes", pa.int64())])
                told = [dict(zip(("a", "b", "bytes"), x)) for x in links]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([told], pa.list_(struct))], names)

    longs = ", ".join(f"{c} array<long>" for c in names[1:-1])
    return narrow.mapInArrow(run, f"id {kind}, {longs}, overlaps array<struct<a: long, b: long, bytes: long>>").withColumnRenamed("id", id_)
