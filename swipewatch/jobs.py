"""The batch jobs end to end: ingest, preprocess, train, evaluate."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT_POLICY, ScalePolicy, TxnConfig
from .functions.scalars import window_label
from .operators.clean import AmountRule, fit_amount_rule
from .operators.encode import apply_classes, fit_encoder, label_as_int, label_classes
from .operators.features import add_features
from .operators.metrics import confusion_matrix, report
from .operators.models import CHOICES, TRAINERS, class_counts, model_metrics, score
from .operators.split import has_times, random_split, stratify_by, time_split
from .sources import stored
from .sources.history import StoredHistory, features_from_history
from .sources.ingest import ingest, save_snapshot
from .sources.paths import exists, fresh_path


@dataclass(frozen=True)
class Prepared:
    """Encoded train and test rows, the fitted encoder, its slot names and the settings used."""

    train: DataFrame
    test: DataFrame
    encoder: PipelineModel
    names: list
    settings: dict


def preprocess(
    df: DataFrame,
    cfg: TxnConfig = TxnConfig(),
    test_size: float = 0.2,
    seed: int = 42,
    stratify: bool = True,
    drop=(),
    id_columns=None,
    clean_scope: str = "all",
    policy: ScalePolicy = DEFAULT_POLICY,
    work_path: str | None = None,
) -> Prepared:
    """Features, amount cleaning, split and encoding of a transaction table.

    Statistics and the split cut are taken from the narrow input. The feature table is then
    written once, one folder per part of the split, because fitting the encoder and the
    models reads it several times.
    """
    if cfg.label not in df.columns:
        raise ValueError(f"target column {cfg.label!r} not found")
    if clean_scope not in ("all", "train"):
        raise ValueError("clean_scope must be 'all' or 'train'")
    by_time = has_times(df, cfg)
    if by_time:
        marked = time_split(df, test_size, cfg, policy)
    else:
        label = stratify_by(df, cfg.label) if stratify else None
        marked = random_split(df, test_size, seed, label, cfg.id, policy)
    # a text label becomes its class number on the narrow input, before any feature is made of it
    classes = label_classes(marked.filter("is_train"), cfg.label)
    if classes is not None:
        marked = apply_classes(marked, cfg.label, classes)
    ids = list(dict.fromkeys([cfg.id, cfg.user, cfg.merchant] if id_columns is None else id_columns))
    dropped = {cfg.label, cfg.time, *drop, *ids}

    made = add_features(marked, cfg, policy=policy) if by_time else marked
    rule = None
    if cfg.amount in df.columns:  # learned from the raw amounts, applied after the features
        scope = marked.filter("is_train") if clean_scope == "train" else marked
        rule = fit_amount_rule(scope, cfg.amount, policy=policy)
        made = rule.apply(made, cfg.amount)
    made = label_as_int(made, cfg.label)
    path = work_path or fresh_path(df.sparkSession, "features")
    made.withColumn("is_train", F.col("is_train").cast("int")).write.mode("overwrite").partitionBy("is_train").parquet(path)
    stored_rows = df.sparkSession.read.parquet(path)

    columns = [c for c in stored_rows.columns if c not in dropped and c != "is_train"]
    train, test = stored_rows.filter("is_train = 1"), stored_rows.filter("is_train = 0")
    encoder, names = fit_encoder(train, columns, policy)
    kept = [c for c in ids if c in stored_rows.columns]

    def encoded(part):
        return encoder.transform(part).select(*kept, "features", F.col(cfg.label).alias("label"))

    settings = {
        "roles": {k: v for k, v in asdict(cfg).items() if k != "windows"},
        "windows": [window_label(w) for w in cfg.windows],
        "feature_names": names,
        "drop_columns": sorted(drop),
        "id_columns": ids,
        "time_based_split": by_time,
        "test_size": test_size,
        "seed": seed,
        "clean_scope": clean_scope,
        "label_classes": classes,
        "amount_rule": None if rule is None else asdict(rule),
    }
    return Prepared(encoded(train), encoded(test), encoder, names, settings)


def run_preprocess(spark: SparkSession, table_path: str, out_path: str, **options) -> Prepared:
    """Preprocess a stored table and store feature sets, encoder and settings under ``out_path``."""
    done = preprocess(spark.read.parquet(table_path), work_path=f"{out_path}/rows", **options)
    stored.write_features(done.train, f"{out_path}/train")
    stored.write_features(done.test, f"{out_path}/test")
    stored.save_model(done.encoder, f"{out_path}/encoder")
    stored.write_metadata(spark, done.settings, f"{out_path}/settings")
    return done


def score_table(
    df: DataFrame,
    prepared_path: str,
    model_path: str,
    policy: ScalePolicy = DEFAULT_POLICY,
    history: StoredHistory | None = None,
) -> DataFrame:
    """Predictions for a new transaction table with the stored settings, encoder and model.

    Features come from ``df`` and ``history``; without a history ``df`` should hold the look-back of the rows of
    interest. A label is not needed; where there is one (text as in training), it is used for the fraud rates.
    """
    spark = df.sparkSession
    settings = stored.read_metadata(spark, f"{prepared_path}/settings")
    roles = {k: tuple(v) if isinstance(v, list) else v for k, v in settings["roles"].items()}
    cfg = TxnConfig(**roles, windows=tuple(settings["windows"]))
    if cfg.label not in df.columns:
        df = df.withColumn(cfg.label, F.lit(None).cast("int"))
    elif settings["label_classes"] is not None:
        df = apply_classes(df, cfg.label, settings["label_classes"])
    made = df
    if settings["time_based_split"]:
        made = add_features(df, cfg, policy=policy) if history is None else features_from_history(df, history, cfg, policy)
    if settings["amount_rule"] is not None:
        made = AmountRule(**settings["amount_rule"]).apply(made, cfg.amount)
    encoder = stored.load_model(spark, f"{prepared_path}/encoder")
    kept = [c for c in settings["id_columns"] if c in df.columns]
    encoded = encoder.transform(made).select(*kept, "features")
    return score(stored.load_model(spark, model_path), encoded).drop("features")


def train_models(
    train: DataFrame,
    test: DataFrame | None,
    choice="both",
    params: dict | None = None,
    test_size=0.2,
    seed=42,
    id_: str = TxnConfig.id,
) -> dict:
    """``{name: (model, scored test rows)}``; without a test set a part of ``train`` is held out.

    Models are fitted on all other rows, and all test rows are scored.
    """
    if choice not in CHOICES:
        raise ValueError(f"model must be one of {sorted(CHOICES)}")
    params = params or {}
    if test is None:
        marked = random_split(
            train, test_size, seed, stratify_by(train, "label"), id_ if id_ in train.columns else None
        )
        train, test = marked.filter("is_train").drop("is_train"), marked.filter("NOT is_train").drop("is_train")
    counts = class_counts(train)
    out = {}
    for name in CHOICES[choice]:
        model = TRAINERS[name](train, counts, {"seed": seed, **params.get(name, {})})
        out[name] = (model, score(model, test))
    return out


def run_training(
    spark: SparkSession, train_path: str, test_path: str | None, out_path: str, choice="both", params=None, run="run", **kw
) -> DataFrame:
    """Train, store models and scores, and the metrics under the run's name; returns ``(model, metric, value)``.

    Each model predicts the test rows once; all metrics read the stored scores.
    """
    train = stored.read_features(spark, train_path)
    test = stored.read_features(spark, test_path) if test_path and exists(spark, test_path) else None
    results = None
    for name, (model, scored) in train_models(train, test, choice, params, **kw).items():
        stored.save_model(model, f"{out_path}/{name}")
        scored.drop("features").write.mode("overwrite").parquet(f"{out_path}/scores/{name}")
        rows = model_metrics(spark.read.parquet(f"{out_path}/scores/{name}"), name)
        results = rows if results is None else results.unionByName(rows)
    stored.write_metrics(results, f"{out_path}/metrics", run)
    return stored.read_metrics(spark, f"{out_path}/metrics", run)


def run_evaluation(
    spark: SparkSession, model_path: str, test_path: str, report_path: str, matrix_path: str, normalize: bool = False
) -> DataFrame:
    """Score a stored test set with a stored model; write report and confusion matrix as CSV."""
    model = stored.load_model(spark, model_path)
    scored = score(model, stored.read_features(spark, test_path)).drop("features")
    scores_path = fresh_path(spark, "scores")
    scored.write.parquet(scores_path)
    scored = spark.read.parquet(scores_path)
    out = report(scored)
    stored.save_report(out, report_path)
    confusion_matrix(scored, normalize=normalize).coalesce(1).write.mode("overwrite").option("header", True).csv(
        matrix_path
    )
    return out


def run_ingestion(spark: SparkSession, csv_path: str, table_path: str, snapshot_path: str | None = None, **kw) -> bool:
    """Ingest a CSV and optionally keep a snapshot of what the table then holds."""
    written = ingest(spark, csv_path, table_path, **kw)
    if written and snapshot_path:
        save_snapshot(spark.read.parquet(table_path), snapshot_path)
    return written
