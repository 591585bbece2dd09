"""Packing of tokenised documents into training sequences, in their order, by dynamic programming.

The documents of an input partition form one stream of token ids. A sequence is a window of at most
``width`` tokens of it. Windows may end at the end of a document (free), at the end of a sentence
(``sentence_cost``) or, where there is neither for a while, inside a sentence (``cut_cost``). A
window that is not full costs its padding, except that a window whose length is a power of two
needs none. With ``d[j]`` the least cost of a stream cut at place ``p[j]``,

    d[j] = cost[j] + width - p[j] + min(d[i] + p[i])  over  p[j] - width <= p[i] < p[j]

and the minimum comes from a monotone queue: each place enters and leaves it once.

A partition is read once and never shuffled; a task holds one stretch of ``stretch`` tokens (or one
document, if longer) and carries the last, unfinished window over. Null and empty texts are the end
token alone. Repeated ids and null ids are documents like any other.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections import deque
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm.shared import text_batches, whole_text


@dataclass(frozen=True)
class PackPolicy:
    """Sizes in tokens, costs in tokens of padding that are as bad.

    ``grain``: of the sentence ends within so many tokens only the last is a place to cut.
    ``filler``: without any place for so many tokens, one inside a sentence is made.
    """

    width: int = 4096
    end_id: int = 2
    sentence_cost: float = 4.0
    cut_cost: float = 24.0
    grain: int = 64
    filler: int = 64
    stretch: int = 1 << 19
    known_words: int = 300_000


# Fixed value: what ends a sentence.
SENTENCE_ENDS = ".!?…。！？"
# ASCII marks that may follow a word; the apostrophe can begin a contraction and is left out
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def _byte_symbols() -> dict:
    """The character that stands for each byte in byte-level vocabularies: itself if visible, else one from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


_SYMBOLS = _byte_symbols()


# Stands for the end of a text among words; never part of UTF-8.
_END = b"\xff\xfe"


class Tokens:
    """Ids of many texts at once; words between ASCII white space are tokenised once and kept.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids.
    """

    def __init__(self, path: str | None, limit: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.removesuffix("</w>")[-1:] in tuple(SENTENCE_ENDS)
        self.ends_sentence = ends
        # only a tokenizer that prepares texts as assumed takes the short way
        prepared = json.loads(self.tokenizer.to_str())
        kinds = [n["type"] for n in (prepared["normalizer"] or {}).get("normalizers", [])]
        self.latin = kinds == ["NFC", "Replace", "Lowercase"] and self.tokenizer.model.__class__.__name__ == "BPE"
        self._clear()

    def _clear(self):
        self.known, self.pieces, self.flat, self.used = {}, {}, np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _piece(self, piece: str) -> tuple:
        """Ids of letters alone, or of marks alone: lower-case, one symbol per UTF-8 byte, merged."""
        found = self.pieces.get(piece)
        if found is None:
            if piece.isascii():
                low = piece.lower()
            else:
                low = "".join(map(str.lower, piece)).encode().decode("latin-1").translate(_SYMBOLS)
            found = self.pieces[piece] = tuple([t.id for t in self.tokenizer.model.tokenize(low)])
        return found

    def _plain(self, word: str) -> tuple | None:
        """Ids of Latin letters with ASCII marks after them, the common case, without the usual preparations."""
        core = word.rstrip(_MARKS)
        if not core.isalpha() or len(core) > 200:
            return None
        if not core.isascii() and (max(core) > "\u024f" or "\u0130" in core):
            return None
        if len(core) == len(word):
            return self._piece(word)
        return self._piece(core) + self._piece(word[len(core) :])

    def _ids(self, words: list) -> list:
        texts = [w.decode("utf-8", "replace") for w in words]
        ids = [self._plain(t) if self.latin else None for t in texts]
        rest = [k for k, x in enumerate(ids) if x is None]
        for k, e in zip(rest, self.tokenizer.encode_batch([texts[k] for k in rest], add_special_tokens=False)):
            ids[k] = tuple(e.ids)
        return ids

    def _add(self, words: list, ids: list) -> None:
        n, m, total = len(self.known), len(words), sum(map(len, ids))
        for name, need in (("starts", n + m), ("lengths", n + m), ("flat", self.used + total)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need - len(old), len(old)), old.dtype)]))
        sizes = np.fromiter(map(len, ids), np.int64, m)
        self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.lengths[n : n + m] = sizes
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        self.used += total
        self.known.update(zip(words, range(n, n + m)))

    def encode(self, texts: list, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each closed by ``end_id``, and the number of each."""
        if len(self.known) > self.limit:
            self._clear()
        if _END not in self.known:
            self._add([_END], [(end_id,)])
        # bytes that are no UTF-8 become replacement characters first, so that _END is no word of a text
        texts = [t.decode("utf-8", "replace").encode() if b"\xff" in t else t for t in texts]
        words = b"".join([x for t in texts for x in (t, b" " + _END + b" ")]).split()
        codes = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(codes < 0).tolist()
        if missing:
            new = list(dict.fromkeys([words[i] for i in missing]))
            self._add(new, self._ids(new))
            codes[missing] = [self.known[words[i]] for i in missing]
        sizes = self.lengths[codes]
        ends = np.cumsum(sizes)
        # the k-th id of a word is flat[start + k]; k is its place less that of the word's first id
        ids = self.flat[np.repeat(self.starts[codes] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.diff(ends[codes == self.known[_END]], prepend=0)


@functools.lru_cache(maxsize=2)
def _tokens(path: str | None, limit: int) -> Tokens:
    """One per worker process."""
    return Tokens(path, limit)


def places(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, p: PackPolicy) -> tuple[np.ndarray, np.ndarray]:
    """Where a window may end, in order, and what it costs there. The last place is the last document's end."""
    at = np.flatnonzero(ends_sentence[ids]) + 1
    if len(at):
        cell = at // p.grain
        at = at[np.r_[cell[1:] != cell[:-1], True]]
    soft = np.setdiff1d(at, doc_ends)
    pos = np.concatenate([doc_ends, soft])
    cost = np.concatenate([np.zeros(len(doc_ends)), np.full(len(soft), p.sentence_cost)])
    order = np.argsort(pos, kind="stable")
    pos, cost = pos[order], cost[order]
    before = np.r_[0, pos[:-1]]
    extra = (pos - before - 1) // p.filler
    if extra.any():
        k = np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        filler = np.repeat(before, extra) + k * p.filler
        pos, cost = np.concatenate([pos, filler]), np.concatenate([cost, np.full(len(filler), p.cut_cost)])
        order = np.argsort(pos, kind="stable")
        pos, cost = pos[order], cost[order]
    return pos, cost


def cut_points(pos: np.ndarray, cost: np.ndarray, p: PackPolicy) -> list:
    """The windows' ends of least total cost, the last of ``pos`` included."""
    width, powers = p.width, [1 << k for k in range(9, p.width.bit_length()) if 1 << k < p.width]
    at = [0, *pos.tolist()]
    price = [0.0, *cost.tolist()]
    index = {x: i for i, x in enumerate(at)}
    best, back = [0.0] * len(at), [0] * len(at)
    queue = deque([(0.0, 0)])  # (d[i] + p[i], i), increasing
    for j in range(1, len(at)):
        x = at[j]
        while at[queue[0][1]] < x - width:
            queue.popleft()
        low, i = queue[0]
        low += width - x
        for size in powers:  # no padding at a power of two
            k = index.get(x - size)
            if k is not None and best[k] < low:
                low, i = best[k], k
        d = price[j] + low
        best[j], back[j] = d, i
        d += x
        while queue and queue[-1][0] >= d:
            queue.pop()
        queue.append((d, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def last_windows(start: int, end: int, p: PackPolicy) -> list:
    """Ends of the last window: as it is, or cut into powers of two where that costs less than its padding."""
    size = end - start
    parts = [1 << k for k in range(size.bit_length() - 1, -1, -1) if size >> k & 1]
    if (len(parts) - 1) * p.cut_cost >= p.width - size:
        return [end]
    return (start + np.cumsum(parts)).tolist()


_OUT = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class _Stream:
    """The open end of a partition's stream: documents not yet packed in full."""

    def __init__(self, tokens: Tokens, p: PackPolicy, part: int, with_ids: bool):
        self.tokens, self.p, self.with_ids = tokens, p, with_ids
        self.sequence = part << 32
        self.ids, self.ends, self.docs = np.zeros(0, np.uint32), np.zeros(0, np.int64), []
        self.offset = np.zeros(0, np.int64)  # tokens of each document that were packed before
        self.total = np.zeros(0, np.int64)

    def add(self, docs: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ends = np.concatenate([self.ends, len(self.ids) + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        self.offset = np.concatenate([self.offset, np.zeros(len(sizes), np.int64)])
        self.total = np.concatenate([self.total, sizes])
        self.docs += docs

    def pack(self, last: bool):
        """Columns of the pieces of all windows but, unless it is the ``last`` call, the last one."""
        p = self.p
        cuts = cut_points(*places(self.ids, self.ends, self.tokens.ends_sentence, p), p)
        if last:
            cuts = cuts[:-1] + last_windows(cuts[-2] if len(cuts) > 1 else 0, cuts[-1], p)
        else:
            cuts = cuts[:-1]
        if not cuts:
            return None
        cuts = np.asarray(cuts, np.int64)
        done = int(cuts[-1])
        stops = np.union1d(cuts, self.ends[self.ends <= done])
        starts = np.r_[0, stops[:-1]]
        doc = np.searchsorted(self.ends, starts, side="right")
        window = np.searchsorted(cuts, starts, side="right")
        doc_start = np.r_[0, self.ends[:-1]][doc]
        opens = np.r_[0, cuts[:-1]][window]
        raw = memoryview(np.ascontiguousarray(self.ids, dtype="<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
        out = {
            "doc": [self.docs[i] for i in doc.tolist()],
            "start": starts - doc_start + self.offset[doc],
            "length": stops - starts,
            "ids_crc32": np.asarray(crc, np.int64),
            "doc_tokens": self.total[doc],
            "sequence_id": self.sequence + window,
            "offset": starts - opens,
        }
        if self.with_ids:
            out["ids"] = [self.ids[a:b].astype(np.int32) for a, b in zip(starts.tolist(), stops.tolist())]
        self.sequence += len(cuts)
        keep = self.ends > done
        first = int(np.argmax(keep)) if keep.any() else len(keep)
        begin = np.r_[0, self.ends[:-1]][first:]
        self.offset = self.offset[first:] + np.maximum(0, done - begin)
        self.total, self.docs = self.total[first:], self.docs[first:]
        self.ends, self.ids = self.ends[first:] - done, self.ids[done:]
        return out


def packed(
    docs: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    policy: PackPolicy = PackPolicy(),
    tokenizer_path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: id, where it starts, its length, its sequence and place there.

    ``with_ids`` adds the token ids of each piece, which is the training data itself.
    ``tokenizer_path`` must be readable on every worker; by default the installed vocabulary is used.
    """
    narrow = text_batches(docs).select(F.col(id_).alias("id"), whole_text(text).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches):
        tokens = _tokens(tokenizer_path, policy.known_words)
        stream, id_type = _Stream(tokens, policy, TaskContext.get().partitionId(), with_ids), None

        def batch_of(out):
            columns = [pa.array(out["doc"], id_type), *(pa.array(out[c], pa.int64()) for c in _OUT)]
            names = ["id", *_OUT]
            if with_ids:
                columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            id_type = b.schema.field(0).type
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            room, first = 4 * policy.stretch, 0
            while first < len(texts):  # about a stretch of bytes at a time
                size, k = 0, first
                while k < len(texts) and (k == first or size + len(texts[k]) <= room):
                    size, k = size + len(texts[k]), k + 1
                stream.add(ids[first:k], *tokens.encode(texts[first:k], policy.end_id))
                first = k
                if len(stream.ids) >= policy.stretch and (out := stream.pack(last=False)):
                    yield batch_of(out)
        if len(stream.ids) and (out := stream.pack(last=True)):
            yield batch_of(out)

    schema = f"id {kind}, " + ", ".join(f"`{c}` long" for c in _OUT) + (", ids array<int>" if with_ids else "")
    out = narrow.mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_)
