"""Tree ensembles on feature vectors: weights, training, scoring, search, choice."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.paths import fresh_path
from .metrics import evaluate
from .split import MAX_CLASSES

# Default settings of the two models. Trees of the forest grow until their leaves
# are pure; 30 is the deepest that Spark allows.
FOREST_DEFAULTS = {"numTrees": 300, "maxDepth": 30, "seed": 42}
BOOSTED_DEFAULTS = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.3, "maxBins": 256, "seed": 42}

# How a forest is fitted, not which: trees in one fit, and rows in one of its tasks. Each task of a fit passes on the whole
# histogram of every node, so that deep trees are better dealt to many fits of few tasks than to one of many.
TREES_AT_ONCE = 20
ROWS_PER_TASK = 250_000

# Settings by their usual names in other libraries.
FOREST_NAMES = {
    "n_estimators": "numTrees",
    "max_depth": "maxDepth",
    "min_samples_leaf": "minInstancesPerNode",
    "max_features": "featureSubsetStrategy",
    "random_state": "seed",
}
BOOSTED_NAMES = {
    "n_estimators": "maxIter",
    "max_depth": "maxDepth",
    "learning_rate": "stepSize",
    "subsample": "subsamplingRate",
    "max_bin": "maxBins",
    "random_state": "seed",
}


def _settings(defaults, names, params) -> dict:
    return {**defaults, **{names.get(k, k): v for k, v in (params or {}).items()}}


def class_counts(df: DataFrame, label="label") -> dict:
    """Rows per class; refused where there are more values than a label has."""
    found = df.groupBy(label).agg(F.count("*").alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} label values; is this the label column?")
    return {r[label]: r["n"] for r in found}


def fit_rows(df: DataFrame, most: int, label="label", id_: str | None = None) -> DataFrame:
    """At most about ``most`` rows to fit a model on: those with the smallest hashes, each class its share.

    A class so small that its share would be nothing keeps the row with its smallest hash. The bound is a parameter of
    the caller's choice; scoring always covers all rows. The rows are written, for a fit reads them many times over and would
    go through the whole of ``df`` each time.
    """
    hashed = F.pmod(F.xxhash64(id_ or label, *([] if id_ else df.columns)), F.lit(1_000_000))
    found = df.groupBy(label).agg(F.count("*").alias("n"), F.min(hashed).alias("h")).limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} label values; is this the label column?")
    total, least = sum(r["n"] for r in found), {r[label]: r["h"] for r in found}  # a row per class
    if total <= most:
        return df
    share = int(1_000_000 * most / total)
    kept = hashed < share
    for c, h in least.items():
        if h >= share:
            kept = kept | (F.col(label).eqNullSafe(F.lit(c)) & (hashed == h))
    path = fresh_path(df.sparkSession, "fit_rows")
    df.filter(kept).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positive_weight(counts: dict) -> float:
    """Negatives per positive; 1.0 when either class is missing."""
    positive, negative = counts.get(1, 0), counts.get(0, 0)
    return negative / positive if positive and negative else 1.0


def balanced(df: DataFrame, counts: dict, label="label") -> DataFrame:
    """Weight ``n / (classes * n_c)``: each class has the same total weight."""
    total = sum(counts.values())
    weight = F.lit(1.0)
    for c, n in counts.items():
        weight = F.when(F.col(label) == c, total / (len(counts) * n)).otherwise(weight)
    return df.withColumn("weight", weight)


def train_forest(train: DataFrame, counts: dict, params: dict | None = None):
    """Random forest with balanced class weights (one weight per class for all trees).

    Trees of a forest don't depend on one another, so many are fitted as several forests at the same time, each on all rows,
    and put together. Rows keep the number of their node, so that no pass is sent the trees so far.
    """
    settings = {"cacheNodeIds": True, **_settings(FOREST_DEFAULTS, FOREST_NAMES, params)}
    spark, rows = train.sparkSession, balanced(train, counts).select("features", "label", "weight")
    path = fresh_path(spark, "weighted_rows")
    rows.write.parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path).coalesce(-(-max(1, sum(counts.values())) // ROWS_PER_TASK))
    many = max(1, -(-settings["numTrees"] // TREES_AT_ONCE))

    def fit(k):
        # two trees or more in each, for a tree alone has other rows and features
        size = settings["numTrees"] // many + (k < settings["numTrees"] % many)
        own = {**settings, "numTrees": size, "seed": settings["seed"] + 1_000_003 * k}
        return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", **own).fit(stored)

    with ThreadPool(min(many, spark.sparkContext.defaultParallelism)) as pool:
        return _one_forest(pool.map(inheritable_thread_target(spark)(fit), range(many), chunksize=1))


def _one_forest(forests: list) -> RandomForestClassificationModel:
    """The trees of forests fitted on the same rows as one forest."""
    if len(forests) == 1:
        return forests[0]
    first, gateway = forests[0]._java_obj, SparkContext._gateway
    found = [t for f in forests for t in f._java_obj.trees()]
    of = gateway.new_array(gateway.jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, len(found))
    for n, tree in enumerate(found):
        of[n] = tree
    whole = gateway.jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(
        first.uid(), of, first.numFeatures(), first.numClasses()
    )
    model = forests[0]._copyValues(RandomForestClassificationModel(whole), {forests[0].numTrees: len(found)})
    model._transfer_params_to_java()
    return model


def train_boosted(train: DataFrame, counts: dict, params: dict | None = None):
    """Gradient-boosted trees; positives weigh as many times as there are more negatives."""
    settings = _settings(BOOSTED_DEFAULTS, BOOSTED_NAMES, params)
    model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", **settings)
    weight = F.when(F.col("label") == 1, positive_weight(counts)).otherwise(1.0)
    return model.fit(train.withColumn("weight", weight))


TRAINERS = {"random_forest": train_forest, "boosted_trees": train_boosted}
CHOICES = {"rf": ("random_forest",), "gbt": ("boosted_trees",), "both": ("random_forest", "boosted_trees")}


def score(model, df: DataFrame) -> DataFrame:
    """Add ``prediction`` (class) and ``score`` (probability of class 1)."""
    out = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("prediction", F.col("prediction").cast("int")).drop("rawPrediction", "probability")


def model_metrics(scored: DataFrame, name: str) -> DataFrame:
    return evaluate(scored).select(F.lit(name).alias("model"), "metric", "value")


def best_model(metrics: DataFrame, by: str = "average_precision") -> DataFrame:
    """The model with the greatest value of a metric; the first by name on a tie."""
    chosen = metrics.filter(F.col("metric") == by).agg(
        F.expr("min_by(model, struct(-value, model))").alias("model"), F.max("value").alias("value")
    )
    return chosen.select("model", F.lit(by).alias("metric"), "value")


def feature_importance(model, names, k: int | None = None) -> DataFrame:
    """Vector slots by importance, greatest first; ``k`` is the length of the list."""
    from pyspark.sql import SparkSession

    values = model.featureImportances.toArray().tolist()
    df = SparkSession.getActiveSession().createDataFrame(list(zip(names, values)), "feature string, importance double")
    ordered = df.orderBy(F.desc("importance"), "feature")
    return ordered if k is None else ordered.limit(k)


def search(
    train: DataFrame, counts: dict, grid: dict, kind="rf", folds=3, fold_col="fold", metric="areaUnderROC", params=None
) -> tuple:
    """Grid search over consecutive periods; ``fold_col`` holds their numbers, e.g. from ``time_fold``.

    A setting is judged on each period but the first by a model fitted on all periods before it,
    so nothing is judged by what came later. Returns the best model, fitted on all rows, and
    ``(params, value)`` rows, the value being the mean over the periods.
    """
    if kind == "rf":
        settings = _settings(FOREST_DEFAULTS, FOREST_NAMES, params)
        model, names = RandomForestClassifier(weightCol="weight", **settings), FOREST_NAMES
    else:
        settings = _settings(BOOSTED_DEFAULTS, BOOSTED_NAMES, params)
        model, names = GBTClassifier(weightCol="weight", **settings), BOOSTED_NAMES
    if folds < 2:
        raise ValueError("at least two periods are needed")
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(names.get(name, name)), list(values))
    maps = builder.build()
    judge = BinaryClassificationEvaluator(metricName=metric, weightCol="weight")
    rows = balanced(train, counts)
    values = [0.0] * len(maps)
    for fold in range(1, folds):
        before, now = rows.filter(F.col(fold_col) < fold), rows.filter(F.col(fold_col) == fold)
        for n, fitted in model.fitMultiple(before, maps):
            values[n] += judge.evaluate(fitted.transform(now)) / (folds - 1)
    best = max(range(len(maps)), key=lambda n: (values[n] if judge.isLargerBetter() else -values[n], -n))
    shown = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)), float(value))
        for m, value in zip(maps, values)
    ]
    return model.fit(rows, maps[best]), train.sparkSession.createDataFrame(shown, "params string, value double")
