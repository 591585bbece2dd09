"""Hard negatives against a full comparison in whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swipewatch.llm import mining
from swipewatch.llm.mining import MiningPolicy

TINY = MiningPolicy(block_values=200, tile_values=48, few_values=0, salts=3)
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, is_anchor, p=MiningPolicy()):
    taken = {}
    for d, v, label in rows:
        if d is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken[(d, label, tuple(math.floor(256 * x) for x in v))] = None
    taken = list(taken)

    def product(x, y):
        return sum(a * b for a, b in zip(x[2], y[2]))

    out = []
    for a in taken:
        if not is_anchor(a[0]):
            continue
        scored = sorted([(-product(a, r), r[0], r[1]) for r in taken])
        positives = [(d, -s) for s, d, label in scored if label == a[1] and d != a[0]][: p.positives]
        for d, s in positives:
            fit = [(e, -t) for t, e, label in scored if label != a[1] and p.least * s <= -100 * t <= p.most * s]
            out += [(a[0], d, k, e, s, t) for k, (e, t) in enumerate(fit[: p.negatives], 1)]
    return sorted(out)


def found(spark, rows, every=3, p=TINY):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, score int").repartition(3)
    out = mining.mined(df, anchor=F.col("id") % every == 0, p=p)
    return sorted(tuple(r[c] for c in NAMES) for r in out.collect())


def _vectors(n, dims, seed, spread=0.3):
    dice = np.random.default_rng(seed)
    middle = dice.normal(size=(4, dims))
    labels = dice.integers(0, 4, n)
    x = middle[labels] * 0.5 + dice.normal(size=(n, dims)) * spread + 0.4
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return [(k, x[k].tolist(), int(labels[k])) for k in range(n)]


@pytest.mark.parametrize(("dims", "p"), [(24, TINY), (64, MiningPolicy()), (5, TINY), (70, MiningPolicy(block_values=2048, tile_values=1024))])
def test_equals_full_comparison(spark, dims, p):
    rows = _vectors(160, dims, dims)
    want = brute(rows, lambda d: d % 3 == 0)
    assert found(spark, rows, p=p) == want and len(want) > 300


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = _vectors(40, 6, 1) + [
        (None, [0.1] * 6, 1),
        (101, None, 1),
        (102, [0.1] * 6, None),
        (103, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1),
        (104, [nan] + [0.1] * 5, 1),
        (105, [0.1] * 5 + [-inf], 1),
        (106, [], 2),
        (107, [0.5, 0.5], 2),
        (108, [0.0] * 6, 3),
        (109, [30.0] * 6, 0),
        (110, [0.25] * 9, 1),
    ]
    rows += [(111, [0.3] * 6, 1)] * 3 + [(114, [0.3] * 6, 1), (114, [0.2] * 6, 2), (117, [0.3] * 6, 2)]
    assert found(spark, rows) == brute(rows, lambda d: d % 3 == 0)


def test_ties_and_one_label(spark):
    rows = [(k, [0.5, 0.5, -0.5], 1) for k in range(30)]
    assert found(spark, rows) == []
    rows += [(k, [0.4, 0.4, -0.4], 2) for k in range(30, 60)]
    assert found(spark, rows) == brute(rows, lambda d: d % 3 == 0) != []


def test_no_rows(spark):
    assert found(spark, []) == []


def test_huge_components_do_not_fail(spark):
    rows = [(k, [3e38, -1e30, float(k)], k % 2) for k in range(12)]
    assert isinstance(found(spark, rows), list)


def test_intervals_hold_the_product(spark):
    dice = np.random.default_rng(3)
    for width in (1, 2, 8, 64, 128):
        x, y = dice.integers(-300, 300, (50, width)), dice.integers(-300, 300, (9, width))
        x[0] = 0
        codes, queries = mining.Codes.of(x, 4), mining.Queries(y, 7)
        low, high = queries.intervals(codes, slice(0, 9))
        exact = y @ x.T
        assert (low <= exact).all() and (exact <= high).all()
        if width >= 64:
            assert (high - low).mean() < 0.5 * (np.linalg.norm(y, axis=1).mean() * np.linalg.norm(x, axis=1).mean())
