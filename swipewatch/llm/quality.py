"""Document quality by regularised quadratic discriminant analysis.

A document is described by transformed statistics of its text (below). Per class the mean and the
covariance are summed in one grouped aggregation over all labelled rows; covariances are shrunk
towards their pooled value and towards a multiple of the identity. Their Cholesky factors are
computed once and travel with the model: a score is the difference of two Mahalanobis log densities,
which two small matrix products give for a whole batch. A logistic curve fitted to a histogram of
these differences (a bounded number of bins) turns it into a probability.

Null and empty texts have all statistics zero and are scored like any other. Rows without label
teach nothing; rows without id are scored. With only one class among the labels every score is that
class's share, smoothed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm.shared import id_bucket, stored, text_batches, whole_text

STATISTICS = (
    "log_bytes",
    "log_words",
    "word_bytes",
    "word_bytes_sd",
    "lower",
    "upper",
    "digits",
    "marks",
    "rare_marks",
    "high_bytes",
    "types",
    "lines",
    "line_types",
    "stops",
    "marks_at_end",
    "short_words",
    "long_words",
    "shouted",
    "top_word",
    "repeated_pairs",
)
_KIND = np.zeros(256, np.uint8)  # 0 control and space, 1 lower, 2 upper, 3 digit, 4 common mark, 5 rare mark, 6 beyond ASCII
for _b in range(33, 127):
    _c = chr(_b)
    _KIND[_b] = 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in ".,;:!?'\"()-" else 5
_KIND[128:] = 6
_SPACES = frozenset(b" \t\n\r\x0b\x0c")
_SHOUT = re.compile(rb"(?<![^\s])[A-Z][A-Z][A-Z.!?,]*(?![^\s])")
_STOP = re.compile(rb"[.!?](?=\s|$)")


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics of one text (UTF-8)."""
    out = np.zeros(len(STATISTICS))
    words = text.split()
    n = len(words)
    if not n:
        return out
    size = len(text)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=7)
    solid = max(1, int(kinds[1:].sum()))
    lengths = np.fromiter(map(len, words), np.int64, n)
    share = kinds[1:] / solid
    types = set(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = n - 1 - len(set(zip(words, words[1:]))) if n > 1 else 0
    last = np.fromiter((w[-1] for w in words), np.uint8, n)
    marked = _KIND[last]
    codes = np.unique(lengths, return_counts=True)[1]
    out[:] = (
        np.log1p(size),
        np.log1p(n),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        share[0],
        np.sqrt(share[1]),
        np.sqrt(share[2]),
        np.sqrt(share[3]),
        np.sqrt(share[4]),
        np.sqrt(share[5]),
        np.log(len(types) / n + 0.01),
        np.log1p(len(lines) / n * 100),
        np.log(len(set(lines)) / len(lines) + 0.01),
        np.log1p(len(_STOP.findall(text)) / n * 100),
        np.sqrt((marked == 5).mean()),
        (lengths <= 3).mean(),
        (lengths >= 12).mean(),
        np.sqrt(len(_SHOUT.findall(text)) / n),
        np.sqrt(codes.max() / n),
        np.sqrt(pairs / n),
    )
    return out


def with_statistics(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ``held_out``, ``x`` array<double>) of each row."""

    def run(batches):
        for b in batches:
            x = np.zeros((b.num_rows, len(STATISTICS)))
            for k, t in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                x[k] = statistics(t)
            flat = pa.array(x.ravel())
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(ends, flat)], ["id", "held_out", "x"]
            )

    narrow = text_batches(docs).select(F.col(id_).alias("id"), (id_bucket(id_, 4) == 2).alias("held_out"), whole_text(text).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, held_out boolean, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Scaling, and per class mean, inverse Cholesky factor and constant of the log density."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple
    whiteners: tuple
    constants: tuple
    curve: tuple = (1.0, 0.0)
    clip: float = 8.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -self.clip, self.clip)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        if not self.means:
            return np.full(len(x), self.constants[0])
        z = self.scaled(x)
        dense = [c - 0.5 * (((z - m) @ w) ** 2).sum(1) for m, w, c in zip(self.means, self.whiteners, self.constants)]
        return dense[1] - dense[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -500, 500)))


def _sums(rows: DataFrame, centre, scale, clip: float) -> dict:
    """Per class: rows, sums and products of the scaled statistics; one row per class."""
    d = len(STATISTICS)
    z = [
        F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col("x")[i] - F.lit(float(centre[i]))) / F.lit(float(scale[i]))))
        for i in range(d)
    ]
    flat = rows.select("label", *[z[i].alias(f"z{i}") for i in range(d)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    found = flat.groupBy("label").agg(
        F.count("*").alias("n"),
        *[F.sum(f"z{i}").alias(f"s{i}") for i in range(d)],
        *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"p{i}_{j}") for i, j in pairs],
    )
    out = {}
    for r in found.collect():
        product = np.zeros((d, d))
        for i, j in pairs:
            product[i, j] = product[j, i] = r[f"p{i}_{j}"]
        out[r["label"]] = (r["n"], np.array([r[f"s{i}"] for i in range(d)]), product)
    return out


def _curve(bins: list) -> tuple:
    """(a, b) of the logistic curve over (label, margin, rows) by Newton steps, slightly damped."""
    y, m, w = (np.array(c, float) for c in zip(*bins))
    design, at = np.stack([m, np.ones_like(m)], 1), np.array([0.1, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -500, 500)))
        slope = design.T @ (w * (y - p)) - 1e-3 * at
        bend = (design * (w * p * (1 - p) + 1e-12)[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        at = at + step * min(1.0, 1.0 / (1e-12 + np.abs(step).max()))
    return (max(float(at[0]), 1e-6), float(at[1]))


def fit(rows: DataFrame, pooled: float = 0.2, ridge: float = 0.02) -> Discriminant:
    """A discriminant of labelled rows (``label`` 0 or 1, ``x``), stored already.

    ``pooled`` is the weight of the common covariance, ``ridge`` that of the scaled identity.
    """
    d = len(STATISTICS)
    moments = rows.agg(
        F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)],
        *[F.stddev_pop(F.col("x")[i]).alias(f"d{i}") for i in range(d)],
    ).first()
    if not moments["n"]:
        return Discriminant(np.zeros(d), np.ones(d), (), (), (0.0,))
    centre = np.array([moments[f"m{i}"] for i in range(d)])
    scale = np.array([moments[f"d{i}"] for i in range(d)])
    scale[scale < 1e-9] = 1.0
    sums = _sums(rows, centre, scale, Discriminant.clip)
    if len(sums) < 2:
        (label, (n, *_)), = sums.items()
        share = (n * label + 1) / (n + 2)
        return Discriminant(centre, scale, (), (), (float(np.log(share / (1 - share))),))
    means, covs, counts = [], [], []
    for label in (0, 1):
        n, s, product = sums[label]
        mean = s / n
        means.append(mean)
        covs.append(product / n - np.outer(mean, mean))
        counts.append(n)
    common = (covs[0] * counts[0] + covs[1] * counts[1]) / sum(counts)
    whiteners, constants = [], []
    for cov, n in zip(covs, counts):
        cov = (1 - pooled) * cov + pooled * common
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiteners.append(np.linalg.inv(factor).T)
        constants.append(float(np.log(n / sum(counts)) - np.log(np.diag(factor)).sum()))
    model = Discriminant(centre, scale, tuple(means), tuple(whiteners), tuple(constants))

    def margins(batches):
        for b in batches:
            m = np.clip(model.margin(_matrix(b.column(1))), -400, 400)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(m))], ["label", "margin"])

    bins = rows.select("label", "x").mapInArrow(margins, "label int, margin double").groupBy("label", "margin").count()
    curve = _curve([tuple(r) for r in bins.collect()])  # at most 2 x 801 rows
    return Discriminant(centre, scale, tuple(means), tuple(whiteners), tuple(constants), curve)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def labelled(stats: DataFrame, labels: DataFrame, id_: str = "doc_id", label: str = "quality") -> DataFrame:
    """(label, x) of all labelled rows that are not held out, stored."""
    marks = labels.select(F.col(id_).alias("id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)")
    return stored(stats.where("NOT held_out").join(marks, "id").select("label", "x"), "labelled")


def scored(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", cut: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score``, ``predicted``."""
    stats = stored(with_statistics(docs, id_, text), "statistics")
    model = fit(labelled(stats, labels, id_))

    def run(batches):
        for b in batches:
            score = model.score(_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score), pa.array((score >= cut).astype(np.int32))],
                ["id", "held_out", "score", "predicted"],
            )

    kind = stats.schema["id"].dataType.simpleString()
    out = stats.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_)


def keep_good(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", cut: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject. Labels of fewer than two classes reject nothing.

    Statistics are computed twice, for the fit and for the decision, so that texts needn't be
    shuffled to meet their scores.
    """
    rows = labelled(stored(with_statistics(docs, id_, text), "statistics"), labels, id_)
    if rows.select("label").distinct().count() < 2:
        return docs
    model = fit(rows)

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        x = np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))
        return pd.Series(model.score(x) >= cut)

    return text_batches(docs).where(good(whole_text(text).cast("binary")))
