"""Classification metrics as Spark aggregates.

Ranking metrics first collapse the rows to one per distinct score (combined map-side), then
take running totals in score order. Those run in ordered chunks when there are many distinct
scores, so no task ever sorts all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_POLICY, ScalePolicy
from ..plans.chunks import ordered_sums, plan_chunks
from .split import MAX_CLASSES

# The rows of the evaluation report, in order.
REPORT_ROWS = ("Accuracy", "Precision", "Recall", "F1 Score", "ROC AUC", "Average Precision")


def _share(top: str, bottom: str) -> str:
    return f"IF({bottom} = 0, 0D, {top} / {bottom})"


def threshold_metrics(df: DataFrame, label="label", prediction="prediction", by=()) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 in one pass; an empty divisor gives 0.

    Rows without label or prediction are not judged.
    """
    cells = {
        "tp": f"{label} = 1 AND {prediction} = 1",
        "fp": f"{label} <> 1 AND {prediction} = 1",
        "fn": f"{label} = 1 AND {prediction} <> 1",
        "hit": f"{label} = {prediction}",
    }
    cells["n"] = f"{label} IS NOT NULL AND {prediction} IS NOT NULL"
    aggs = [F.expr(f"count_if({x})").alias(f"__{n}") for n, x in cells.items()]
    counted = df.groupBy(*by).agg(*aggs)
    return counted.selectExpr(
        *by,
        f"{_share('__hit', '__n')} AS accuracy",
        f"{_share('__tp', '(__tp + __fp)')} AS precision",
        f"{_share('__tp', '(__tp + __fn)')} AS recall",
        f"{_share('2 * __tp', '(2 * __tp + __fp + __fn)')} AS f1_score",
    )


def score_steps(
    df: DataFrame, label="label", score="score", by: str | None = None, policy: ScalePolicy = DEFAULT_POLICY
) -> DataFrame:
    """One row per distinct score: ``pos, neg`` at it and ``pos_above, neg_above`` over it."""
    group = f"{by} AS __k" if by else "0 AS __k"
    steps = (
        df.selectExpr(group, f"-cast({score} AS double) AS __t", f"{label} = 1 AS __p")
        .filter("__t IS NOT NULL AND __p IS NOT NULL")
        .groupBy("__k", "__t")
        .agg(F.expr("count_if(__p)").alias("pos"), F.expr("count_if(NOT __p)").alias("neg"))
        .withColumn("__i", F.lit(0).cast("bigint"))
    )
    plan = plan_chunks(steps, "__k", "__t", "__i", policy)
    return ordered_sums(steps, "__k", "__t", "__i", {"pos_above": "pos", "neg_above": "neg"}, plan).selectExpr(
        "__k", "-__t AS score", "pos", "neg", "pos_above", "neg_above"
    )


def ranking_metrics(
    df: DataFrame, label="label", score="score", by: str | None = None, policy: ScalePolicy = DEFAULT_POLICY
) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision.

    Both are null where one class is missing.
    """
    steps = score_steps(df, label, score, by, policy)
    summed = steps.groupBy("__k").agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.expr("sum(neg * (pos_above + pos / 2D))").alias("won"),
        F.expr("sum(pos * ((pos_above + pos) / (pos_above + pos + neg_above + neg)))").alias("precise"),
    )
    return summed.selectExpr(
        *([f"__k AS {by}"] if by else []),
        "IF(p > 0 AND n > 0, won / (cast(p AS double) * n), NULL) AS roc_auc",
        "IF(p > 0, precise / p, NULL) AS average_precision",
    )


def roc_curve(df: DataFrame, label="label", score="score", policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """False and true positive rate at each distinct score as threshold, and the origin."""
    steps = score_steps(df, label, score, policy=policy)
    totals = df.filter(F.expr(f"{score} IS NOT NULL")).agg(
        F.expr(f"count_if({label} = 1)").alias("p"), F.expr(f"count_if({label} <> 1)").alias("n")
    ).first()
    p, n = float(totals["p"]), float(totals["n"])
    points = steps.selectExpr(
        f"IF({n}D > 0, (neg_above + neg) / {n}D, NULL) AS fpr",
        f"IF({p}D > 0, (pos_above + pos) / {p}D, NULL) AS tpr",
        "score AS threshold",
    )
    origin = df.sparkSession.createDataFrame([(0.0, 0.0, float("inf"))], "fpr double, tpr double, threshold double")
    return origin.unionByName(points)


def corners(curve: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """The points of :func:`roc_curve` that are no inner points of a straight run in steps of equal counts.

    As many rows as the curve has corners, not as the table has different scores. The origin, the first and the last
    step always stay.
    """
    steps = curve.selectExpr("0 AS __k", "-threshold AS __t", "0L AS __i", "fpr", "tpr", "threshold")
    plan = plan_chunks(steps, "__k", "__t", "__i", policy)
    order = "PARTITION BY __k, __chunk ORDER BY __t"
    point = "struct(fpr, tpr)"
    out = plan.attach(steps, "__k", "__t", "__i").selectExpr(
        "*", f"lag({point}) OVER ({order}) AS __before", f"lead({point}) OVER ({order}) AS __after"
    )
    if not plan.empty:
        ends = plan.located(plan.only_hot(steps, "__k"), "__t", "__i").groupBy("__hot", "__chunk")
        ends = ends.agg(F.expr(f"min_by({point}, __t)").alias("first"), F.expr(f"max_by({point}, __t)").alias("last"))
        # the ends of the chunks beside; as few rows as there are cut points
        beside = "PARTITION BY __hot ORDER BY __chunk"
        ends = ends.selectExpr("__hot AS __ck", "__chunk AS __cc", f"lag(last) OVER ({beside}) AS __l", f"lead(first) OVER ({beside}) AS __f")
        out = out.join(F.broadcast(ends), F.expr("__k = __ck AND __chunk = __cc"), "left")
        out = out.withColumns({"__before": F.expr("coalesce(__before, __l)"), "__after": F.expr("coalesce(__after, __f)")})
    # a rate is a count over a constant, so equal steps differ by rounding only
    turns = " OR ".join(f"abs(__after.{c} - 2 * {c} + __before.{c}) > 1e-12" for c in ("fpr", "tpr"))
    first_step = "__before.fpr = 0 AND __before.tpr = 0"
    return out.where(f"__before IS NULL OR __after IS NULL OR {first_step} OR {turns}").select("fpr", "tpr", "threshold")


def evaluate(
    df: DataFrame,
    label="label",
    prediction="prediction",
    score: str | None = "score",
    policy: ScalePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """``(metric, value)`` rows; the ranking metrics only when there is a score.

    All metrics are of the same rows: those with label, prediction and score (if there is one).
    """
    for needed in (label, prediction, *([score] if score else [])):
        df = df.filter(F.col(needed).isNotNull())
    names = ["accuracy", "precision", "recall", "f1_score"]
    out = _to_rows(threshold_metrics(df, label, prediction), names)
    if score is None:
        return out
    return out.unionByName(
        _to_rows(ranking_metrics(df, label, score, policy=policy), ["roc_auc", "average_precision"])
    )


def report(df: DataFrame, label="label", prediction="prediction", score: str | None = "score", policy=DEFAULT_POLICY):
    """The evaluation report: columns ``Metric, Value``, always six rows."""
    long = evaluate(df, label, prediction, score, policy)
    names = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "average_precision"]
    wide = long.groupBy().agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])
    pairs = ", ".join(f"'{shown}', {n}" for shown, n in zip(REPORT_ROWS, names))
    return wide.selectExpr(f"stack({len(names)}, {pairs}) AS (Metric, Value)")


def _to_rows(wide: DataFrame, names) -> DataFrame:
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return wide.selectExpr(f"stack({len(names)}, {pairs}) AS (metric, value)")


def confusion_matrix(
    df: DataFrame, label="label", prediction="prediction", normalize: bool = False, classes=(0, 1)
) -> DataFrame:
    """Counts for every pair of the classes that occur, or shares of each label's rows.

    ``classes`` have their rows and columns in any case; a column of more than ``MAX_CLASSES`` values is refused. Rows without label or prediction form a
    class of their own, null. A label without rows has shares 0.
    """
    pairs = df.select(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
    counted = pairs.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    for side in ("label", "prediction"):
        if pairs.select(side).distinct().limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} values in {label if side == 'label' else prediction}; is this a class?")
    kind = pairs.schema["label"].dataType.simpleString()
    named = F.array(*[F.lit(c) for c in classes]).cast(f"array<{kind}>")
    # a row per class and side; the grid of all pairs is the result's form
    every = counted.agg(
        F.array_distinct(
            F.concat(F.collect_set("label"), F.collect_set(F.col("prediction").cast(kind)), named)
        ).alias("known"),
        (F.count_if(F.col("label").isNull() | F.col("prediction").isNull()) > 0).alias("gaps"),
    ).select(
        F.when(F.col("gaps"), F.concat("known", F.array(F.lit(None).cast(kind)))).otherwise(F.col("known")).alias("all")
    )
    grid = every.select("all", F.explode("all").alias("l")).select("l", F.explode("all").alias("p"))
    same = F.col("l").eqNullSafe(F.col("label")) & F.col("p").eqNullSafe(F.col("prediction").cast(kind))
    cells = grid.join(counted, same, "left").select(
        F.col("l").alias("label"), F.col("p").alias("prediction"), F.coalesce("n", F.lit(0)).alias("n")
    )
    if not normalize:
        return cells
    of_label = counted.groupBy(F.col("label").alias("__l")).agg(F.sum("n").alias("__n"))
    joined = cells.join(of_label, F.col("label").eqNullSafe(F.col("__l")), "left")
    return joined.select("label", "prediction", F.coalesce(F.col("n") / F.col("__n"), F.lit(0.0)).alias("share"))
