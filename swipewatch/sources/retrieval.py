"""The stored queries on transactions and users. Values are always bound, never pasted in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The columns each stored query returns.
TRANSACTION_COLUMNS = (
    "transaction_id",
    "user_id",
    "merchant_id",
    "transaction_date",
    "amount",
    "currency",
    "status",
    "fraud",
)
USER_COLUMNS = ("user_id", "user_name", "email", "phone", "created_at")


def _query(df: DataFrame, columns, where: str = "true", **args) -> DataFrame:
    text = f"SELECT {', '.join(columns)} FROM {{source}} WHERE {where}"
    return df.sparkSession.sql(text, args=args, source=df)


def transactions_between(df: DataFrame, start, end) -> DataFrame:
    """Transactions from ``start`` to ``end``, both included; the range reaches the scan."""
    where = "transaction_date BETWEEN cast(:start AS timestamp) AND cast(:end AS timestamp)"
    return _query(df, TRANSACTION_COLUMNS, where, start=start, end=end)


def fraud_transactions(df: DataFrame) -> DataFrame:
    """Transactions labelled as fraud, without the label. The condition reaches the scan."""
    boolean = isinstance(df.schema["fraud"].dataType, T.BooleanType)
    return _query(df, TRANSACTION_COLUMNS[:-1], "fraud" if boolean else "fraud = 1")


def transactions_of_user(df: DataFrame, user_id: int) -> DataFrame:
    return _query(df, TRANSACTION_COLUMNS, "user_id = :user_id", user_id=user_id)


def all_users(df: DataFrame) -> DataFrame:
    return _query(df, USER_COLUMNS)


def find_users(df: DataFrame, user_id: int | None = None, email: str | None = None) -> DataFrame:
    """Users with this id or this e-mail address."""
    return _query(df, USER_COLUMNS, "user_id = :user_id OR email = :email", user_id=user_id, email=email)
