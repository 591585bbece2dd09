"""Language of web pages: Bayesian fusion of evidence.

Four kinds of evidence are multiplied:

* the text: likelihoods of hashed byte trigrams, learned from all documents whose language is given;
* the language that the markup declares, weighed by how often such declarations were right;
* the suffix of the address, weighed likewise;
* the host: a prior smoothed hierarchically, host towards domain towards all pages.

How often declarations and suffixes go with a language, and what hosts mostly hold, comes from grouped
aggregation of the pages' text-only posteriors, combined map-side, so that a host with a third of all
pages is no bottleneck. A page's own vote is taken out before it is judged.

Null and empty pages have no text evidence; null addresses share the empty host. Languages are those
among the documents, in alphabetical order; of equally likely ones the first is given. Without any
document the language is null.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm.shared import stored, text_batches, whole_text

CELLS = 1 << 14


@dataclass(frozen=True)
class LanguagePolicy:
    """``temper``: neighbouring trigrams are not independent; their log likelihoods count so much.

    ``most_text``: text evidence of a page counts as that of at most so many trigrams.
    ``weight``: rows that a parent's distribution counts for. ``max_languages``: bound of the model.
    """

    temper: float = 0.25
    most_text: float = 400.0
    weight: float = 4.0
    max_languages: int = 250


_SKIP = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
# Comments, scripts, styles and everything else before the first html tag are passed over once, from left to
# right; one that is not closed reaches to the end.
_BEFORE = re.compile(rb"(?is)<!--|<(?:(script|style)\b|html(?=[\s/>]))")
_CLOSED = {b"script": re.compile(rb"(?i)</script\b"), b"style": re.compile(rb"(?i)</style\b"), None: re.compile(rb"-->")}
_ATTRIBUTE = re.compile(rb"""[\s/]*+([^\s=>/]++|=)(?:\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+""")
_CODE = re.compile(rb"\s*([A-Za-z]{2,3})")
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def visible(page: bytes) -> bytes:
    """The text of a page without markup, scripts and styles."""
    text = _SKIP.sub(b" ", page)
    return entities.unescape(text.decode("utf-8", "replace")).encode() if b"&" in text else text


def declared_language(page: bytes) -> str:
    """What the first html tag outside comments, scripts and styles declares, in lower case; empty if nothing.

    ``xml:lang`` counts where there is no ``lang``.
    """
    at = 0
    while m := _BEFORE.search(page, at):
        if m[0][1:].lower() == b"html":
            at, said = m.end(), {}
            while a := _ATTRIBUTE.match(page, at):
                if a[1].lower() in (b"lang", b"xml:lang"):
                    code = _CODE.match((a[2] or b"").strip(b"\"'"))
                    said.setdefault(a[1].lower(), code[1].decode().lower() if code else "")
                at = a.end()
            return said.get(b"lang") or said.get(b"xml:lang", "")
        end = _CLOSED[m[1] and m[1].lower()].search(page, m.end())
        if not end:
            return ""
        at = end.end()
    return ""


def trigrams(text: bytes) -> np.ndarray:
    """Cells of the byte trigrams of the lower-cased letters, words one space apart."""
    b = np.frombuffer(b" ".join(text.translate(_LETTERS).split()), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] * np.uint32(7919) + b[1:-1] * np.uint32(104729) + b[2:] * np.uint32(1299709)) >> np.uint32(3)) % np.uint32(CELLS)


def text_model(docs: DataFrame, text: str = "text", lang: str = "lang", p: LanguagePolicy = LanguagePolicy()) -> tuple:
    """(languages, log likelihoods as cells x languages) from all documents with a language."""

    def run(batches):
        counts = {}
        for b in batches:
            for language, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if language not in counts:
                    counts[language] = np.zeros(CELLS, np.int64)
                counts[language] += np.bincount(trigrams(t), minlength=CELLS)
        for language, n in counts.items():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(n[cell])], ["lang", "cell", "n"]
            )

    rows = text_batches(docs).where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), whole_text(text).alias("text"))
    cells = rows.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    cells = stored(cells, "trigrams")
    names = [r[0] for r in rows.select("lang").distinct().orderBy("lang").limit(p.max_languages + 1).collect()]
    if len(names) > p.max_languages:
        raise ValueError(f"more than {p.max_languages} languages")
    counts = np.zeros((CELLS, len(names)))
    at = {name: k for k, name in enumerate(names)}
    for r in cells.collect():  # at most CELLS x max_languages rows
        counts[r["cell"], at[r["lang"]]] = r["n"]
    smooth = counts + 0.5
    return names, np.log(smooth / smooth.sum(0))


def _address(url: str | None) -> tuple:
    """(host, domain, suffix) in lower case; empty where there is none."""
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    host = m[1].lower().strip(".") if m else ""
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def _posterior(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _vectors(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def identified(
    pages: DataFrame,
    docs: DataFrame,
    id_: str = "page_id",
    url: str = "url",
    html: str = "html",
    text: str = "text",
    lang: str = "lang",
    p: LanguagePolicy = LanguagePolicy(),
) -> DataFrame:
    """One row per row of ``pages``: id, ``language``, ``probability``, ``text_language``, ``declared``, ``host``."""
    names, logs = text_model(docs, text, lang, p)
    k = len(names)
    if not k:
        none = F.lit(None).cast("string")
        return pages.select(
            id_, none.alias("language"), none.cast("double").alias("probability"), none.alias("text_language"),
            none.alias("declared"), none.alias("host"),
        )

    def read(batches):
        for b in batches:
            own = np.zeros((b.num_rows, k))
            declared, where = [], []
            for i, (u, page) in enumerate(zip(b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist())):
                cells = trigrams(visible(page))
                own[i] = logs[cells].sum(0) * p.temper * min(1.0, p.most_text / max(1, len(cells)))
                declared.append(declared_language(page))
                where.append(_address(u))
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k)
            own -= own.max(1, keepdims=True) if len(own) else 0
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (own, _posterior(own) if len(own) else own)]
            hosts = [pa.array([w[j] for w in where], pa.string()) for j in range(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(declared, pa.string()), *hosts, *lists],
                ["id", "declared", "host", "domain", "suffix", "own", "vote"],
            )

    narrow = text_batches(pages).select(F.col(id_).alias("id"), F.col(url).alias("url"), whole_text(html).alias("html"))
    kind = narrow.schema["id"].dataType.simpleString()
    rows = narrow.mapInArrow(
        read, f"id {kind}, declared string, host string, domain string, suffix string, own array<double>, vote array<double>"
    )
    rows = stored(rows, "evidence")

    def votes(df, by, name, column="vote"):
        sums = [F.sum(F.col(column)[i]).alias(f"v{i}") for i in range(k)]
        return df.groupBy(*by).agg(F.array(*sums).alias(name)) if by else df.agg(F.array(*sums).alias(name))

    # hosts first; domains, suffixes and the whole from the hosts
    hosts = stored(votes(rows, ["host", "domain", "suffix"], "of_host"), "hosts")
    domains = votes(hosts, ["domain"], "of_domain", "of_host")
    suffixes = votes(hosts, ["suffix"], "of_suffix", "of_host")
    placed = hosts.join(domains, "domain").join(suffixes, "suffix").select("host", "of_host", "of_domain", "of_suffix")
    said = votes(rows, ["declared"], "of_declared")
    total = votes(hosts, [], "all", "of_host").first()["all"]
    total = np.array([x or 0.0 for x in total])
    a = p.weight
    share = (total + 1) / (total.sum() + k)

    def judge(batches):
        for b in batches:
            own, vote, of_host, of_domain, of_suffix, of_declared = (_vectors(b.column(c), k) for c in range(3, 9))
            less = lambda x: np.maximum(x - vote, 0)
            domain = (less(of_domain) + a * share) / (less(of_domain).sum(1, keepdims=True) + a)
            prior = (less(of_host) + a * domain) / (less(of_host).sum(1, keepdims=True) + a)
            whole = total - vote
            # P(suffix | language): its share of the language's votes, smoothed by its share of all
            def given(x, hint=0.0):
                part = (less(x).sum(1, keepdims=True) + 1) / (whole.sum(1, keepdims=True) + 2)
                return (less(x) + a * np.clip(part + hint, 0, 1)) / (whole + a)

            declared = b.column(1).to_pylist()
            hint = np.array([[0.5 if d == n.lower() else 0.0 for n in names] for d in declared]).reshape(-1, k)
            joint = own + np.log(prior) + np.log(given(of_suffix)) + np.log(given(of_declared, hint))
            made = _posterior(joint) if len(joint) else joint
            best, by_text = made.argmax(1), own.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([names[i] for i in best], pa.string()),
                    pa.array(made.max(1) if len(made) else [], pa.float64()),
                    pa.array([names[i] for i in by_text], pa.string()),
                    pa.array([d or None for d in declared], pa.string()),
                    b.column(2),
                ],
                ["id", "language", "probability", "text_language", "declared", "host"],
            )

    joined = rows.select("id", "declared", "host", "own", "vote").join(placed, "host").join(said, "declared")
    joined = joined.select("id", "declared", "host", "own", "vote", "of_host", "of_domain", "of_suffix", "of_declared")
    out = joined.mapInArrow(
        judge, f"id {kind}, language string, probability double, text_language string, declared string, host string"
    )
    return out.withColumnRenamed("id", id_)
