"""Column expressions: time, money, guards. All stay inside the JVM."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = 1_000_000

# Seconds per accepted window unit.
_UNIT_SECONDS = {
    "ms": 0.001,
    "s": 1,
    "min": 60,
    "h": 3600,
    "d": 86400,
    "w": 604800,
}

_WINDOW = re.compile(r"([0-9]+)(ms|s|min|h|d|w)", re.IGNORECASE)


def window_micros(window) -> int:
    """Length of a look-back window such as ``"24h"`` or a ``timedelta``, in microseconds.

    Bare numbers, negative spans and spelled-out units are refused rather than guessed at.
    """
    if isinstance(window, dt.timedelta):
        micros = window // dt.timedelta(microseconds=1)
    else:
        found = _WINDOW.fullmatch(window.strip()) if isinstance(window, str) else None
        if not found:
            raise ValueError(f"Invalid window {window!r}: use a form like 30min, 1h, 7d.")
        micros = round(int(found.group(1)) * _UNIT_SECONDS[found.group(2).lower()] * MICROS)
    if micros <= 0:
        raise ValueError(f"Invalid window {window!r}: the length must be positive.")
    return micros


def window_label(window) -> str:
    if isinstance(window, dt.timedelta):
        return f"{window // dt.timedelta(seconds=1)}s"
    return window.strip()


def as_timestamp(df: DataFrame, name: str, on_bad: str = "fail", formats: tuple = ()) -> Column:
    """UTC timestamp from a timestamp, date or text column.

    Text is read as ISO date or timestamp with optional offset, then by each of
    ``formats``. What cannot be read is null, or ends the job when ``on_bad="fail"``.
    """
    if on_bad not in ("fail", "null"):
        raise ValueError("on_bad must be 'fail' or 'null'")
    raw, kind = F.col(name), df.schema[name].dataType
    if not isinstance(kind, T.StringType):
        return raw.cast("timestamp")
    parsed = F.coalesce(F.try_to_timestamp(raw), *[F.try_to_timestamp(raw, F.lit(f)) for f in formats])
    if on_bad == "null":
        return parsed
    message = F.concat(F.lit(f"unreadable time in column {name}: "), raw)
    return F.when(raw.isNotNull() & parsed.isNull(), F.raise_error(message).cast("timestamp")).otherwise(parsed)


def micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def number(df: DataFrame, name: str) -> Column:
    """The column as double with NaN turned into null; a text column is a schema error."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.NumericType, T.BooleanType)):
        raise TypeError(f"column {name} must be numeric, found {kind.simpleString()}")
    col = F.col(name)
    if isinstance(kind, T.BooleanType):
        return col.cast("int").cast("double")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col.cast("double"))
    return col.cast("double")


def is_missing(df: DataFrame, name: str) -> Column:
    col = F.col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def cents(col: Column) -> Column:
    """Money as an exact integer, so that sums and differences of sums carry no error."""
    return F.rint(col * 100).cast("bigint")


def binarize(col: Column, threshold: float = 0.5) -> Column:
    return F.when(col > threshold, 1).otherwise(0)


def hash_fraction_key(id_col: Column, seed: int) -> Column:
    """A 52-bit pseudo-random integer per id, the same on every run and engine."""
    digest = F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


# The parts of the rule score.
RULE_BASE = 0.02
RULE_LARGE_AMOUNT = 0.08
RULE_STATUS = {"declined": 0.05, "reversed": 0.08}
RULE_RANGE = (0.0, 0.5)


def rule_score(amount: Column, status: Column, large_above: float) -> Column:
    """Heuristic fraud probability from the amount and the status of a transaction."""
    by_status = F.lit(0.0)
    for name, risk in RULE_STATUS.items():
        by_status = F.when(status == name, risk).otherwise(by_status)
    by_amount = F.when(amount > large_above, RULE_LARGE_AMOUNT).otherwise(0.0)
    low, high = RULE_RANGE
    return F.least(F.greatest(F.lit(RULE_BASE) + by_amount + by_status, F.lit(low)), F.lit(high))
