"""Trees from histograms against the same ensembles in plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from swipewatch.operators import trees
from swipewatch.operators.trees import BoostSettings, ForestSettings, balanced_forest, boosted

WIDTH = 3


def rows_of(n=1000, seed=2):
    dice = random.Random(seed)
    rows = []
    for k in range(n):
        x = [dice.gauss(0, 1), float(dice.randrange(5)), dice.choice([None, float("nan"), 1.5, -2.0])]
        chance = 1 / (1 + math.exp(-(x[0] - 1.5 + (x[1] == 3) * 2 + (x[2] is None or x[2] != x[2]) * 0.8)))
        rows.append((k, x, int(dice.random() < chance)))
    return rows


def table(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "transaction_id long, features array<double>, label int").repartition(parts)
    return df.withColumn("features", F.transform("features", lambda v: F.coalesce(v, F.lit(float("nan")))))


def bin_of(x, cuts):
    if x is None or x != x:
        return 0
    return 1 + sum(c < x for c in cuts)


def plain_split(rows, bins, penalty, least):
    """Every feature, cut and side of the gaps; ``rows`` are (binned features, g, h)."""
    best = None
    g0, h0 = sum(g for _, g, _ in rows), sum(h for _, _, h in rows)
    for gap_left in (True, False):
        for f in range(WIDTH):
            for upto in range(1, bins):
                left = [(g, h) for x, g, h in rows if (gap_left if x[f] == 0 else x[f] <= upto)]
                g, h = sum(g for g, _ in left), sum(h for _, h in left)
                if min(h, h0 - h) < least or h <= 0 or h0 - h <= 0:
                    continue
                gain = g * g / (h + penalty) + (g0 - g) ** 2 / (h0 - h + penalty) - g0 * g0 / (h0 + penalty)
                if gain > 1e-9 * max(1, abs(h0)) and (best is None or gain > best[0] * (1 + 1e-10)):
                    best = (gain, f, upto, gap_left)
    return best


def plain_tree(rows, depth, bins, penalty, least, leaf):
    """Nested (feature, upto, gap_left, left, right), or a leaf's value."""
    found = plain_split(rows, bins, penalty, least) if depth else None
    if not found:
        return leaf(sum(g for _, g, _ in rows), sum(h for _, _, h in rows))
    _, f, upto, gap_left = found
    left = [r for r in rows if (gap_left if r[0][f] == 0 else r[0][f] <= upto)]
    right = [r for r in rows if r not in left]
    return f, upto, gap_left, *(plain_tree(part, depth - 1, bins, penalty, least, leaf) for part in (left, right))


def value_of(tree, x):
    while isinstance(tree, tuple):
        f, upto, gap_left, left, right = tree
        tree = left if (gap_left if x[f] == 0 else x[f] <= upto) else right
    return tree


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return pytest.approx(tree.value[node], rel=1e-9)
    return (
        tree.feature[node], tree.upto[node], tree.gap_left[node], nested(tree, tree.left[node]), nested(tree, tree.left[node] + 1),
    )


def test_boosted_trees_equal_plain_ones(spark):
    rows = rows_of()
    p = BoostSettings(rounds=5, depth=3, rate=0.3, bins=8, store_every=2)
    made = boosted(table(spark, rows), p)
    weight = sum(1 - y for *_, y in rows) / sum(y for *_, y in rows)
    bins = [[bin_of(v, made.cuts[f]) for f, v in enumerate(x)] for _, x, _ in rows]
    margin = [0.0] * len(rows)
    leaf = lambda g, h: -0.3 * g / (h + 1)
    for tree in made.trees:
        data = []
        for k, (b, m, (*_, y)) in enumerate(zip(bins, margin, rows)):
            chance, w = 1 / (1 + math.exp(-m)), weight if y else 1.0
            fixed = lambda v: round(v * trees.FIXED) / trees.FIXED
            data.append(((*b, k), fixed(w * (chance - y)), fixed(w * chance * (1 - chance))))
        want = plain_tree(data, 3, 8, 1.0, 1.0, leaf)
        assert nested(tree) == want
        margin = [m + value_of(want, b) for m, b in zip(margin, bins)]
    scores = {r["transaction_id"]: r["score"] for r in made.score(table(spark, rows)).collect()}
    for (k, *_), m in zip(rows, margin):
        assert scores[k] == pytest.approx(1 / (1 + math.exp(-m)), rel=1e-6)


def test_trees_do_not_depend_on_partitions(spark):
    rows = rows_of(600)
    p, q = BoostSettings(rounds=4, depth=4, bins=16), ForestSettings(trees=6, depth=5, bins=16)
    one, many = ([boosted(table(spark, rows, n), p), balanced_forest(table(spark, rows, n), q)] for n in (1, 7))
    for a, b in zip(one, many):
        assert [nested(t) for t in a.trees] == [nested(t) for t in b.trees]


def test_each_sample_is_balanced(spark):
    rows = rows_of(800, seed=4)
    df = table(spark, rows).select(F.xxhash64("transaction_id").alias("h"), F.col("label").cast("double").alias("label"))
    totals = trees.sample_totals(df, 20, 42)
    weights = trees.balanced_weights(totals)
    both = totals * weights / trees.FIXED
    assert np.allclose(both[:, 0], both[:, 1], rtol=1e-4) and len({tuple(t) for t in totals.tolist()}) > 15
    # Poisson with mean 1
    n = trees.bootstrap_counts(np.arange(200_000), 3, 42)
    assert abs(n.mean() - 1) < 0.01 and abs((n == 0).mean() - math.exp(-1)) < 0.005 and abs(n.var() - 1) < 0.02


def test_forest_equals_plain_one(spark):
    rows = rows_of(400, seed=6)
    p = ForestSettings(trees=3, depth=3, bins=8, features=WIDTH)
    df = table(spark, rows)
    made = balanced_forest(df, p)
    hashes = {r[0]: r[1] for r in df.select("transaction_id", F.xxhash64("transaction_id")).collect()}
    for t, tree in enumerate(made.trees):
        n = trees.bootstrap_counts(np.array([hashes[k] for k, *_ in rows]), t, p.seed)
        totals = [sum(c for c, (*_, y) in zip(n, rows) if y == label) for label in (0, 1)]
        w = [round(sum(totals) / 2 / c * trees.FIXED) / trees.FIXED for c in totals]
        data = [
            ((*[bin_of(v, made.cuts[f]) for f, v in enumerate(x)], k), c * w[y] * y, c * w[y])
            for c, (k, x, y) in zip(n.tolist(), rows) if c
        ]
        assert nested(tree) == plain_tree(data, 3, 8, 0.0, min(w), lambda g, h: g / h)


def test_learns_and_stops(spark):
    rows = rows_of(3000, seed=8)
    df = table(spark, rows).withColumn("hold", F.col("transaction_id") % 4 == 0)
    p = BoostSettings(rounds=60, depth=3, rate=0.3, bins=16, patience=10, check_every=5)
    made = boosted(df, p, valid=F.col("hold"))
    assert len(made.trees) < 60 and max(v for _, v in made.history) == dict(made.history)[len(made.trees)]
    out = made.score(df.where("hold"))
    gaps = out.groupBy("label").agg(F.avg("score").alias("s")).orderBy("label").collect()
    assert gaps[1]["s"] - gaps[0]["s"] > 0.15
    assert abs(sum(made.importance()) - 1) < 1e-9 and made.importance()[0] == max(made.importance())


def test_odd_tables(spark):
    p, q = BoostSettings(rounds=2, depth=2, bins=4), ForestSettings(trees=2, depth=2, bins=4)
    one_class = table(spark, [(k, [float(k), 1.0, None], 1) for k in range(10)])
    for df in (one_class, one_class.limit(0), table(spark, [(1, [None] * 3, 0), (1, [None] * 3, 1), (2, [None] * 3, None)])):
        for made in (boosted(df, p), balanced_forest(df, q)):
            assert all(0 <= r["score"] <= 1 for r in made.score(one_class).collect()) or not made.cuts
    vectors = spark.createDataFrame([(1, Vectors.dense([1.0, 2.0]), 0), (2, Vectors.sparse(2, [0], [5.0]), 1)], ["transaction_id", "features", "label"])
    assert boosted(vectors, p).score(vectors).columns == ["transaction_id", "label", "score", "prediction"]
