"""Turning a feature table into vectors, with everything learned on training rows only.

The fitted encoder is a plain ``PipelineModel`` of built-in stages, so it is saved, loaded
and applied to batches and streams like any other.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_POLICY, ScalePolicy
from ..plans.ranks import in_batches, quantiles
from .profile import column_roles
from .split import MAX_CLASSES

log = logging.getLogger(__name__)


MAX_CATEGORIES = 10_000


def label_classes(df: DataFrame, column: str) -> list | None:
    """Classes of a text label in ascending order, to be learned from training rows; None for a number."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return None
    found = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {column}")
    return sorted(r[0] for r in found)


def apply_classes(df: DataFrame, column: str, classes: list, output: str | None = None) -> DataFrame:
    """Text label to the number of its class; a class that was not learned ends the job, null stays null."""
    text = F.col(column)
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), text) - 1
    unseen = F.raise_error(F.concat(F.lit(f"unseen class in {column}: "), text)).cast("int")
    code = F.when(text.isNull(), F.lit(None).cast("int")).when(place >= 0, place.cast("int")).otherwise(unseen)
    return df.withColumn(output or column, code)


def encode_labels(df: DataFrame, column: str, output: str) -> DataFrame:
    """Text label to a whole-number code; classes in ascending order."""
    return apply_classes(df, column, label_classes(df, column), output)


def label_as_int(df: DataFrame, column: str, classes: list | None = None) -> DataFrame:
    """Labels for training: booleans and 0/1 numbers as whole numbers, text as class codes."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return apply_classes(df, column, label_classes(df, column) if classes is None else classes)
    return df.withColumn(column, F.col(column).cast("int"))


def _plain(df: DataFrame, name: str) -> str:
    """SQL text of a numeric column as double with NaN as null."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return f"cast(cast(`{name}` AS int) AS double)"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return f"nullif(cast(`{name}` AS double), double('NaN'))"
    return f"cast(`{name}` AS double)"


@dataclass(frozen=True)
class NumericRule:
    """Per numeric column: fill value and divisor, and the divisor of its missing flag if any."""

    name: str
    median: float
    scale: float
    flag_scale: float | None


def fit_numeric(df: DataFrame, columns, policy: ScalePolicy = DEFAULT_POLICY) -> tuple:
    """Exact medians and population deviations; ``(rules, columns without any value)``."""
    values = df.selectExpr(*[f"{_plain(df, c)} AS `{c}`" for c in columns])
    medians = {c: q[0.5] for c, q in quantiles(values, columns, [0.5], policy).items()}
    empty = [c for c in columns if medians[c] is None]
    kept = [c for c in columns if c not in empty]
    aggs = []
    for c in columns:
        value = F.col(f"`{c}`")
        filled = F.lit(None) if c in empty else F.stddev_pop(F.coalesce(value, F.lit(medians[c])))
        aggs.append([F.count("*"), F.count(value), filled])
    rules = []
    for c, (rows, known, spread_of) in zip(columns, in_batches(values, aggs)):
        missing = 1.0 - known / rows if rows else 0.0
        spread = math.sqrt(missing * (1.0 - missing))
        flag = (spread or 1.0) if known < rows else None
        if c in kept:
            rules.append(NumericRule(c, medians[c], spread_of or 1.0, flag))
        elif flag is not None:
            rules.append(NumericRule(c, math.nan, math.nan, flag))
    return rules, empty


def most_frequent(df: DataFrame, columns) -> dict:
    """Most frequent non-null value per column, as text; the smallest on a tie. One pass."""
    if not columns:
        return {}
    pairs = ", ".join(f"'{n}', cast(`{c}` AS string)" for n, c in enumerate(columns))
    best = (
        df.selectExpr(f"stack({len(columns)}, {pairs}) AS (c, v)")
        .filter("v IS NOT NULL")
        .groupBy("c", "v")
        .agg(F.count("*").alias("n"))
        .groupBy("c")
        .agg(F.expr("min_by(v, struct(-n, v))").alias("v"))
    )
    found = {int(r["c"]): r["v"] for r in best.collect()}
    return {c: found.get(n) for n, c in enumerate(columns)}


def _text_of(value: float) -> str:
    """SQL text of a double, infinite ones included (the fitted encoder is made of SQL text)."""
    return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"


def numeric_expressions(df: DataFrame, rules, impute_only: bool = False) -> list:
    """``(name, SQL text)`` of the imputed and scaled columns, then of the missing flags."""
    out = []
    for r in rules:
        if not math.isnan(r.median):
            scale = "" if impute_only else f" / {_text_of(r.scale)}"
            out.append((f"num__{r.name}", f"coalesce({_plain(df, r.name)}, {_text_of(r.median)}){scale}"))
    for r in rules:
        if r.flag_scale is not None:
            scale = "" if impute_only else f" / {_text_of(r.flag_scale)}"
            out.append((f"num__missingindicator_{r.name}", f"cast({_plain(df, r.name)} IS NULL AS double){scale}"))
    return out


def _check_categories(df: DataFrame, columns) -> None:
    """Refuse text columns with so many values that a vector slot for each makes no sense.

    Their values are kept on the driver and in the model, so their number has to be bounded.
    """
    if not columns:
        return
    row = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"n{n}") for n, c in enumerate(columns)]).first()
    wide = [c for n, c in enumerate(columns) if row[n] > MAX_CATEGORIES]
    if wide:
        raise ValueError(f"more than about {MAX_CATEGORIES} categories in {wide}; drop or group them")


def fit_encoder(train: DataFrame, columns, policy: ScalePolicy = DEFAULT_POLICY, output="features") -> tuple:
    """Fit on ``train``; returns ``(PipelineModel, names of the vector slots)``.

    Numbers: exact median for gaps, a flag per column that had gaps, division by the
    population deviation. Everything else: most frequent value for gaps, one slot per
    category in ascending order; categories not seen in training give all zeros.
    """
    columns = list(columns)
    numeric, categorical = column_roles(train.select(*columns)) if columns else ([], [])
    if not columns:
        raise ValueError("no feature columns to encode")
    _check_categories(train, categorical)
    rules, empty = fit_numeric(train, numeric, policy) if numeric else ([], [])
    fills = most_frequent(train, categorical)
    empty += [c for c in categorical if fills[c] is None]
    if empty:
        log.warning("columns without any training value are left out: %s", empty)
    categorical = [c for c in categorical if fills[c] is not None]

    numbers = numeric_expressions(train, rules)
    texts = [
        (f"__text_{c}", "coalesce(cast(`{}` AS string), '{}')".format(c, fills[c].replace("\\", "\\\\").replace("'", "\\'")))
        for c in categorical
    ]
    listed = ", ".join(f"{x} AS `{name}`" for name, x in numbers + texts)
    if not listed:
        raise ValueError("no feature column has any training value")
    stages = [SQLTransformer(statement=f"SELECT *, {listed} FROM __THIS__")]
    names = [n for n, _ in numbers]
    inputs = list(names)
    if categorical:
        shaped = stages[0].transform(train)
        indexer = StringIndexer(
            inputCols=[n for n, _ in texts],
            outputCols=[f"__index_{c}" for c in categorical],
            stringOrderType="alphabetAsc",
            handleInvalid="keep",
        ).fit(shaped)
        # "keep" adds a last slot for unseen values; dropLast removes just that one
        encoder = OneHotEncoder(
            inputCols=[f"__index_{c}" for c in categorical],
            outputCols=[f"__hot_{c}" for c in categorical],
            dropLast=True,
        ).fit(indexer.transform(shaped))
        stages += [indexer, encoder]
        inputs += [f"__hot_{c}" for c in categorical]
        for c, labels in zip(categorical, indexer.labelsArray):
            names += [f"cat__{c}_{v}" for v in labels]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output))
    return PipelineModel(stages), names
