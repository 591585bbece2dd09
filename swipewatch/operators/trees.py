"""Tree ensembles grown from histograms: second-order boosting and forests with balanced bootstrap samples.

Features are cut into bins once, and rows are stored as one byte per feature. A level of a tree is one aggregate: each task
adds up two numbers per (tree, node, feature, bin) of its rows, Spark adds those of all tasks, and the best splits are read off
the sums, whose size depends on nodes, features and bins and not on the rows. Both numbers are whole (fixed point), so the
sums, and with them the trees, are the same however the rows are dealt.

Boosting: gradient and Hessian of the logistic loss; a split's gain is that of the second-order expansion. Forest: weight of
the positives and weight of all, for which the same gain without a penalty is the decrease of Gini impurity; every tree
has Poisson bootstrap weights from a hash of row and tree, and classes are balanced within each tree's own sample.
Gaps (null or NaN) go to the side that gains more. The fewer bins than values, the coarser the thresholds; cut values come
from a quantile sketch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.paths import fresh_path
from .metrics import evaluate

GAP = 0  # the bin of missing values
FIXED = float(1 << 24)
CELLS = 1 << 22  # (tree, node, feature, bin) summed in one job; more trees take more jobs
MAX_FEATURES = 10_000


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    penalty: float = 1.0  # on squared leaf values
    least_gain: float = 0.0
    least_weight: float = 1.0  # Hessian of a child
    bins: int = 64
    positive_weight: float | None = None  # default: negatives per positive
    patience: int | None = None  # rounds without a better average precision on the validation rows
    check_every: int = 5
    store_every: int = 20  # rounds after which margins are written


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 300
    depth: int = 12
    bins: int = 64
    least_rows: int = 1  # bootstrap rows of a child
    features: int | None = None  # tried per node; default: the square root of all
    seed: int = 42


@dataclass
class Tree:
    """Nodes in the order they were made; ``feature`` is -1 in leaves. A bin up to ``upto`` goes left."""

    feature: list = field(default_factory=list)
    upto: list = field(default_factory=list)
    gap_left: list = field(default_factory=list)
    left: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def add(self) -> int:
        for column, x in ((self.feature, -1), (self.upto, 0), (self.gap_left, True), (self.left, 0), (self.value, 0.0)):
            column.append(x)
        return len(self.feature) - 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Node of each row; the right child of a node follows its left one."""
        feature, upto, left = np.array(self.feature), np.array(self.upto), np.array(self.left)
        gap_left = np.array(self.gap_left)
        node = np.zeros(len(bins), np.int64)
        while True:
            f = feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return node
            at = node[inner]
            b = bins[inner, f[inner]]
            goes_left = np.where(b == GAP, gap_left[at], b <= upto[at])
            node[inner] = left[at] + np.where(goes_left, 0, 1)

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Ensemble:
    """Trees over binned features; ``score`` is the chance of class 1."""

    kind: str  # "boosted" or "forest"
    cuts: list  # per feature, ascending
    trees: list
    history: list = field(default_factory=list)  # (round, average precision) on the validation rows

    def chances(self, bins: np.ndarray) -> np.ndarray:
        total = np.zeros(len(bins))
        for tree in self.trees:
            total += tree.values(bins)
        if self.kind == "forest":
            return total / max(1, len(self.trees))
        return 1 / (1 + np.exp(-total))

    def score(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``score`` and ``prediction``."""
        cuts, chances = self.cuts, self.chances
        names = df.columns
        arrays = df.withColumn("__x", _array(df, features))
        schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("prediction", T.IntegerType())])

        def run(batches):
            for b in batches:
                score = chances(binned(_matrix(b.column(len(names)), len(cuts)), cuts))
                columns = [*b.columns[: len(names)], pa.array(score), pa.array((score > 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*names, "score", "prediction"])

        plain = df.schema[features].dataType.typeName() == "array"
        if plain:
            return arrays.mapInArrow(run, schema)
        # a vector travels as its own type only outside Arrow
        narrow = arrays.drop(features)
        names = narrow.columns[:-1]
        schema = T.StructType([f for f in schema.fields if f.name != features])
        return narrow.mapInArrow(run, schema)

    def importance(self) -> list:
        """Share of the splits that each feature has."""
        splits = np.bincount([f for t in self.trees for f in t.feature if f >= 0], minlength=len(self.cuts))
        return (splits / max(1, splits.sum())).tolist()


def _array(df: DataFrame, features: str):
    return F.col(features) if df.schema[features].dataType.typeName() == "array" else vector_to_array(F.col(features))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)[:, :width]


def binned(x: np.ndarray, cuts: list) -> np.ndarray:
    """One byte per value: 0 for a gap, else 1 and the number of cuts below it."""
    out = np.empty(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), GAP, 1 + np.searchsorted(c, x[:, f], side="left"))
    return out


def cut_values(df: DataFrame, features: str, bins: int) -> list:
    """Ascending cut values of each feature, at most ``bins - 2``, from one aggregate."""
    if not 4 <= bins <= 256:
        raise ValueError("bins must be between 4 and 256")
    x = _array(df, features)
    width = df.select(F.max(F.size(x))).first()[0] or 0
    if width > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    probs = [j / (bins - 1) for j in range(1, bins - 1)]
    if not width:
        return []
    values = [F.when(~F.isnan(x[f]), x[f]) for f in range(width)]
    row = df.agg(*[F.percentile_approx(v, probs, 10_000).alias(f"c{f}") for f, v in enumerate(values)]).first()
    return [np.unique(np.array(c if c is not None else [], np.float64)) for c in row]


def _stored_bins(df: DataFrame, cuts: list, features: str, label: str, id_: str, valid) -> DataFrame:
    """(h, label, valid, bins), stored: hash of the id, binned features."""
    rows = df.select(
        F.xxhash64(id_).alias("h"), F.col(label).cast("double").alias("label"), F.coalesce(valid, F.lit(False)).alias("valid"),
        _array(df, features).alias("x"),
    ).where("label IS NOT NULL")

    def run(batches):
        for b in batches:
            made = binned(_matrix(b.column(3), len(cuts)), cuts)
            column = pa.array([r.tobytes() for r in made], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], column], ["h", "label", "valid", "bins"])

    return _stored(rows.mapInArrow(run, "h long, label double, valid boolean, bins binary"), "binned")


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def histograms(rows: DataFrame, columns: list, numbers, open_: list, trees: list, width: int, bins: int) -> np.ndarray:
    """Sums of two whole numbers over the rows of each open node, feature and bin: (nodes, features, bins, 2).

    ``open_`` lists (tree, node). ``numbers`` gives, for a batch as numpy columns and a tree's number, the two numbers per row.
    """
    places = {}
    for k, (tree, node) in enumerate(open_):
        places.setdefault(tree, {})[node] = k
    cells = width * bins

    def run(batches):
        total = np.zeros((len(open_) * cells, 2), np.int64)
        offsets = np.arange(width) * bins
        for b in batches:
            held = {c: b.column(n).to_numpy(zero_copy_only=False) for n, c in enumerate(columns[:-1])}
            made = _unpacked(b.column(len(columns) - 1), width)
            held["bins"] = made
            for tree, nodes in places.items():
                lookup = np.full(len(trees[tree].feature), -1)
                lookup[list(nodes)] = list(nodes.values())
                at = lookup[trees[tree].leaves(made)]
                one, two = numbers(held, tree)
                mine = np.flatnonzero((at >= 0) & ((one != 0) | (two != 0)))
                cell = (at[mine, None] * cells + offsets + made[mine]).ravel()
                np.add.at(total, cell, np.stack([np.repeat(one[mine], width), np.repeat(two[mine], width)], axis=1))
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some, 0]), pa.array(total[some, 1])], ["cell", "one", "two"])

    made = rows.select(*columns).mapInArrow(run, "cell long, one long, two long").groupBy("cell").agg(F.sum("one"), F.sum("two"))
    out = np.zeros((len(open_) * cells, 2), np.int64)
    for cell, one, two in made.collect():  # at most CELLS
        out[cell] = one, two
    return out.reshape(len(open_), width, bins, 2)


def best_split(sums: np.ndarray, penalty: float, least_gain: float, least_weight: float, allowed=None) -> tuple | None:
    """(gain, feature, upto, gap_left) of the best split of one node, or None. ``sums`` is (features, bins, 2).

    The first feature, then the lowest cut, then gaps to the left are taken where gains are alike.
    """
    x = sums.astype(np.float64)
    total = x[0].sum(0)
    gap = x[:, GAP]
    upto = x[:, 1:].cumsum(1)
    best = None
    for gap_left in (True, False):
        left = upto + gap[:, None] * gap_left
        right = total - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = sum(np.where(s[..., 1] + penalty > 0, s[..., 0] ** 2 / (s[..., 1] + penalty), 0.0) for s in (left, right))
        gain -= total[0] ** 2 / (total[1] + penalty) if total[1] + penalty > 0 else 0.0
        fits = (left[..., 1] >= least_weight) & (right[..., 1] >= least_weight) & (left[..., 1] > 0) & (right[..., 1] > 0)
        if allowed is not None:
            fits &= allowed[:, None]
        gain = np.where(fits, gain, -np.inf)
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        found = (float(gain[f, b]), int(f), int(b) + 1, gap_left)
        # so much is rounding, not gain
        if found[0] > least_gain + 1e-9 * max(1.0, abs(total[1])) and (best is None or found[0] > best[0] * (1 + 1e-12)):
            best = found
    return best


def _grow(rows, columns, numbers, trees, open_, depth, width, bins, split, leaf) -> None:
    """Grows ``trees`` level by level; ``split`` chooses from a node's sums, ``leaf`` gives a node's value."""
    for level in range(depth + 1):
        if not open_:
            return
        step, coming = max(1, CELLS // max(1, width * bins)), []
        for k in range(0, len(open_), step):
            part = open_[k : k + step]
            sums = histograms(rows, columns, numbers, part, trees, width, bins)
            for (t, node), s in zip(part, sums):
                tree, total = trees[t], s[0].sum(0)
                tree.value[node] = leaf(total)
                found = split(t, node, s) if level < depth else None
                if found:
                    _, tree.feature[node], tree.upto[node], tree.gap_left[node] = found
                    tree.left[node] = tree.add()
                    coming += [(t, tree.left[node]), (t, tree.add())]
        open_ = coming


def boosted(
    df: DataFrame,
    p: BoostSettings = BoostSettings(),
    features: str = "features",
    label: str = "label",
    id_: str = "transaction_id",
    valid=None,
) -> Ensemble:
    """Boosted trees. ``valid`` is a condition: such rows are not fitted on, but judge when to stop (``patience``)."""
    valid = F.lit(False) if valid is None else valid
    cuts = cut_values(df.where(~F.coalesce(valid, F.lit(False))), features, p.bins)
    made = Ensemble("boosted", cuts, [])
    rows = _stored_bins(df, cuts, features, label, id_, valid).withColumn("margin", F.lit(0.0))
    fitted = rows.where("NOT valid")
    counts = {r["label"]: r["n"] for r in fitted.groupBy("label").agg(F.count("*").alias("n")).limit(3).collect()}
    if not cuts or not counts:
        return made
    weight = p.positive_weight
    if weight is None:
        weight = counts.get(0.0, 0) / counts[1.0] if counts.get(0.0) and counts.get(1.0) else 1.0
    width, columns, since = len(cuts), ["label", "margin", "bins"], 0
    best = (-1.0, 0)
    for n in range(1, p.rounds + 1):
        recent = made.trees[since:]

        def numbers(held, _, recent=recent):
            margin = held["margin"] + sum(t.values(held["bins"]) for t in recent)
            chance = 1 / (1 + np.exp(-margin))
            w = np.where(held["label"] == 1, weight, 1.0)
            return (np.rint(w * (chance - held["label"]) * FIXED).astype(np.int64), np.rint(w * chance * (1 - chance) * FIXED).astype(np.int64))

        tree = Tree()
        tree.add()
        split = lambda t, node, s: best_split(s / FIXED, p.penalty, p.least_gain, p.least_weight)
        leaf = lambda total: -p.rate * total[0] / (total[1] + p.penalty * FIXED) if total[1] + p.penalty > 0 else 0.0
        _grow(rows.where("NOT valid"), columns, numbers, [tree], [(0, 0)], p.depth, width, p.bins, split, leaf)
        made.trees.append(tree)
        if n % p.store_every == 0:
            rows, since = _stored(_moved(rows, made.trees[since:], width), "margins"), len(made.trees)
        if p.patience and n % p.check_every == 0:
            judged = _moved(rows.where("valid"), made.trees[since:], width).withColumnRenamed("margin", "score")
            found = evaluate(judged.withColumn("score", F.expr("1 / (1 + exp(-score))")).withColumn("prediction", F.expr("cast(score > 0.5 AS int)")))
            value = found.where("metric = 'average_precision'").first()["value"] or 0.0
            made.history.append((n, value))
            if value > best[0]:
                best = (value, n)
            elif n - best[1] >= p.patience:
                break
    if p.patience and made.history:
        made.trees = made.trees[: best[1]]
    return made


def _moved(rows: DataFrame, trees: list, width: int) -> DataFrame:
    """``rows`` with the trees' values added to their margins."""

    def run(batches):
        for b in batches:
            bins = _unpacked(b.column("bins"), width)
            margin = b.column("margin").to_numpy() + sum((t.values(bins) for t in trees), np.zeros(len(bins)))
            at = b.schema.get_field_index("margin")
            yield b.set_column(at, "margin", pa.array(margin, pa.float64()))

    return rows.mapInArrow(run, rows.schema)


def mixed_hash(values: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of each whole number and ``salt``."""
    x = values.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def bootstrap_counts(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's sample: Poisson with mean 1, from the row's hash, wherever the row is."""
    chance = (mixed_hash(hashes, seed * 1_000_003 + tree) >> np.uint64(11)) / float(1 << 53)
    steps = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))
    return np.searchsorted(steps, chance, side="right").astype(np.int64)


def sample_totals(rows: DataFrame, trees: int, seed: int) -> np.ndarray:
    """Rows of class 0 and 1 in each tree's sample: (trees, 2)."""

    def run(batches):
        total = np.zeros((trees, 2), np.int64)
        for b in batches:
            h, label = b.column(0).to_numpy(), b.column(1).to_numpy() == 1
            for t in range(trees):
                n = bootstrap_counts(h, t, seed)
                total[t] += n[~label].sum(), n[label].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(trees)), pa.array(total[:, 0]), pa.array(total[:, 1])], ["t", "no", "yes"])

    found = rows.select("h", "label").mapInArrow(run, "t long, no long, yes long").groupBy("t").agg(F.sum("no"), F.sum("yes"))
    out = np.zeros((trees, 2), np.int64)
    for t, no, yes in found.collect():
        out[t] = no, yes
    return out


def balanced_weights(totals: np.ndarray) -> np.ndarray:
    """Fixed-point weight of a row of each class in each tree: both classes weigh as much in every sample."""
    every = totals.sum(1, keepdims=True)
    return np.rint(np.where(totals > 0, every / (2.0 * np.maximum(totals, 1)), 0.0) * FIXED).astype(np.int64)


def balanced_forest(
    df: DataFrame, p: ForestSettings = ForestSettings(), features: str = "features", label: str = "label", id_: str = "transaction_id"
) -> Ensemble:
    """A forest whose trees each have their own bootstrap sample and their own class weights."""
    cuts = cut_values(df, features, p.bins)
    made = Ensemble("forest", cuts, [])
    rows = _stored_bins(df, cuts, features, label, id_, F.lit(False))
    totals = sample_totals(rows, p.trees, p.seed)
    if not cuts or not totals.any():
        return made
    weights, width = balanced_weights(totals), len(cuts)
    tried = min(width, p.features or max(1, int(np.sqrt(width))))

    def numbers(held, tree):
        yes = held["label"] == 1
        w = bootstrap_counts(held["h"], tree, p.seed) * np.where(yes, weights[tree, 1], weights[tree, 0])
        return np.where(yes, w, 0), w

    def split(tree, node, sums):
        order = mixed_hash(np.arange(width), (p.seed * 1_000_003 + tree) * 65_537 + node + 1)
        allowed = np.zeros(width, bool)
        allowed[np.argsort(order, kind="stable")[:tried]] = True
        light = weights[tree][weights[tree] > 0].min() / FIXED
        return best_split(sums / FIXED, 0.0, 0.0, p.least_rows * light, allowed)

    leaf = lambda total: float(total[0] / total[1]) if total[1] else 0.5
    made.trees = [Tree() for _ in range(p.trees)]
    for tree in made.trees:
        tree.add()
    open_ = [(t, 0) for t in range(p.trees)]
    _grow(rows, ["h", "label", "bins"], numbers, made.trees, open_, p.depth, width, p.bins, split, leaf)
    return made
