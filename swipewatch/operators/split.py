"""Train/test splits: by time, or pseudo-random with stratification.

Both are cuts at an exact rank. The cut row is found by rank selection (``plans.ranks``);
the split itself is then a filter, so no row is moved and no global row number is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_POLICY, ScalePolicy, TxnConfig
from ..functions.scalars import as_timestamp, hash_fraction_key, micros
from ..plans.chunks import tie_key
from ..plans.ranks import lexicographic_cuts

MAX_CLASSES = 1_000
NEVER = 2**53 - 1  # sorts rows without a time last; exact as a double


def _check_size(test_size: float) -> None:
    if not 0.0 < test_size < 1.0:
        raise ValueError(f"test_size must lie in (0, 1), got {test_size}")


def has_times(df: DataFrame, cfg: TxnConfig = TxnConfig()) -> bool:
    """Whether the table can be split by time: the column exists and holds any value."""
    return cfg.time in df.columns and not df.filter(F.col(cfg.time).isNotNull()).isEmpty()


def time_split(
    df: DataFrame, test_size: float = 0.2, cfg: TxnConfig = TxnConfig(), policy: ScalePolicy = DEFAULT_POLICY
) -> DataFrame:
    """Add boolean ``is_train``: the earliest ``max(1, int(n * (1 - test_size)))`` rows.

    Ties are ordered by id, then by a hash of the row; rows without a time come last.
    """
    _check_size(test_size)
    t = F.coalesce(micros(as_timestamp(df, cfg.time, cfg.on_bad_time, cfg.time_formats)), F.lit(NEVER))
    keyed = df.withColumns({"__g": F.lit(0), "__t": t, "__i": tie_key(df, cfg.id), "__r": _row_hash(df)})
    n = keyed.count()
    if n == 0:
        return df.withColumn("is_train", F.lit(True))
    k = max(1, int(n * (1 - test_size)))
    cuts = lexicographic_cuts(keyed, "__g", ["__t", "__i", "__r"], {0: k - 1}, {0: n}, policy)
    return _marked(keyed, ["__t", "__i", "__r"], cuts, df.columns, True)


def _row_hash(df: DataFrame) -> Column:
    """Tells rows with the same time and id apart by their other values."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)])


def _marked(keyed: DataFrame, keys, cuts: dict, columns, inside_is_train: bool) -> DataFrame:
    """Add ``is_train``; up to the cut of its group a row is inside.

    Rows that tie in every key are equal, so any of them may be taken: they are counted and
    given out again, the wanted number of them as inside.
    """
    inside, shared, take = F.lit(False), F.lit(False), F.lit(0)
    for g, cut in cuts.items():
        here, upto, equal = F.col("__g").eqNullSafe(F.lit(g)), F.lit(False), F.lit(True)
        for key, v in zip(keys, cut.values):
            upto = upto | (equal & (F.col(key) < F.lit(v)))
            equal = equal & (F.col(key) == F.lit(v))
        inside = inside | (here & (upto | equal))
        if cut.take < cut.tied:
            shared = shared | (here & equal)
            take = F.when(here & equal, cut.take).otherwise(take)
    flag = inside if inside_is_train else ~inside
    if all(cut.take == cut.tied for cut in cuts.values()):
        return keyed.withColumn("is_train", flag).select(*columns, "is_train")
    apart = keyed.filter(~shared).withColumn("is_train", flag).select(*columns, "is_train")
    counted = keyed.filter(shared).withColumn("__take", take).groupBy(*columns, "__take").agg(F.count("*").alias("__n"))
    given = counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "__n")).alias("__k"))
    first = F.col("__k") <= F.col("__take")
    return apart.unionByName(
        given.withColumn("is_train", first if inside_is_train else ~first).select(*columns, "is_train")
    )


def allocate(counts: dict, n_test: int) -> dict:
    """Test rows per class: proportional, rounded by largest remainder to total ``n_test``."""
    total = sum(counts.values())
    exact = {c: n * n_test / total for c, n in counts.items()}
    out = {c: math.floor(x) for c, x in exact.items()}
    missing = n_test - sum(out.values())
    for c in sorted(counts, key=lambda c: (out[c] - exact[c], str(c)))[:missing]:
        out[c] += 1
    return out


def random_split(
    df: DataFrame,
    test_size: float = 0.2,
    seed: int = 42,
    label: str | None = None,
    id_: str | None = "transaction_id",
    policy: ScalePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Add boolean ``is_train``; ``ceil(n * test_size)`` rows are test rows.

    Rows are ordered by a hash of id and seed, then by a hash of the row, so the split is the same
    on every run and its sizes are exact where ids repeat. With
    ``label`` and more than one class each class gives its share.
    """
    _check_size(test_size)
    tie = tie_key(df, id_)
    group = F.col(label) if label else F.lit(0)
    keyed = df.withColumns({"__g": group, "__i": tie, "__h": hash_fraction_key(tie, seed), "__r": _row_hash(df)})
    counts = _class_counts(keyed)
    if not counts:
        return df.withColumn("is_train", F.lit(True))
    if label and len(counts) > 1 and min(counts.values()) < 2:
        raise ValueError("a class with a single row cannot be in both parts")
    n_test = math.ceil(sum(counts.values()) * test_size)
    wanted = {c: k - 1 for c, k in allocate(counts, n_test).items() if k > 0}
    cuts = lexicographic_cuts(keyed, "__g", ["__h", "__i", "__r"], wanted, counts, policy)
    return _marked(keyed, ["__h", "__i", "__r"], cuts, df.columns, False)


def _class_counts(keyed: DataFrame) -> dict:
    """Rows per label value; refused where there are more values than a label has."""
    found = keyed.groupBy("__g").agg(F.count("*").alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} label values; is this the label column?")
    return {r["__g"]: r["n"] for r in found}


def stratify_by(df: DataFrame, label: str) -> str | None:
    """The label when it has more than one class, else none."""
    return label if df.select(label).distinct().limit(2).count() > 1 else None


def time_fold(df: DataFrame, folds: int, cfg: TxnConfig = TxnConfig(), policy: ScalePolicy = DEFAULT_POLICY) -> Column:
    """Fold number by time, for cross-validation over consecutive periods of equal size."""
    from ..plans.ranks import quantiles

    t = micros(as_timestamp(df, cfg.time, cfg.on_bad_time, cfg.time_formats))
    cuts = quantiles(df.select(t.alias("t")), ["t"], [j / folds for j in range(1, folds)], policy)["t"]
    fold = F.lit(0)
    for cut in cuts.values():
        fold = fold + F.when(t > cut, 1).otherwise(0)
    return fold.cast("int")
