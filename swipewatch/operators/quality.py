"""Key checks, idempotent appends and the user dimension.

Joins are plain equi-joins: Spark broadcasts a side only below its size limit, and splits a
hot key of a shuffled join at run time (adaptive skew join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_violations(df: DataFrame, keys) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def _any_null(keys) -> Column:
    found = F.lit(False)
    for k in keys:
        found = found | F.col(k).isNull()
    return found


def latest_per_key(df: DataFrame, keys, version) -> DataFrame:
    """One row per key: the one with the greatest ``version``; combined map-side.

    ``version`` is a column name or a list of them, compared in order; where versions tie, the
    greatest row by its other columns' text stays, so that the choice does not depend on the plan.
    Rows with a null in the key identify nothing: they all stay.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    version = [version] if isinstance(version, str) else list(version)
    rest = [c for c in df.columns if c not in keys]
    keyed = df.filter(~_any_null(keys))
    order = F.struct(*[F.col(c) for c in version], F.to_json(F.struct(*rest)))
    newest = F.max_by(F.struct(*rest), order).alias("__row")
    kept = keyed.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])
    return kept.select(*df.columns).unionByName(df.filter(_any_null(keys)))


def merge_append(
    stored: DataFrame, incoming: DataFrame, keys="transaction_id", version=("transaction_date",)
) -> DataFrame:
    """``stored`` plus ``incoming`` with one row per key; incoming rows win over stored ones.

    Of several incoming rows with one key the latest by ``version`` stays. Incoming rows with a
    null in the key stay too, unless the very same row is stored already. So appending the same
    rows a second time changes nothing. Stored rows are only filtered (an anti-join against the
    incoming keys, which Spark broadcasts while they are few), never regrouped.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    fresh = latest_per_key(incoming, keys, [v for v in version if v in incoming.columns] or keys)
    keyed, loose = fresh.filter(~_any_null(keys)), fresh.filter(_any_null(keys))
    names = [f"__old_{k}" for k in range(len(stored.columns))]
    same = F.lit(True)
    for c, n in zip(stored.columns, names):
        same = same & loose[c].eqNullSafe(F.col(n))
    there = stored.filter(_any_null(keys)).toDF(*names)
    kept = stored.join(keyed.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(keyed).unionByName(loose.join(there, same, "left_anti"))


def with_user(txns: DataFrame, users: DataFrame, key="user_id") -> DataFrame:
    """Every transaction with the columns of its user, null where there is none."""
    return txns.join(users, key, "left")


def without_user(txns: DataFrame, users: DataFrame, key="user_id") -> DataFrame:
    """Transactions whose user is not in ``users``."""
    return txns.join(users.select(key), key, "left_anti")
