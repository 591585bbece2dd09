"""What the operators have in common: stored intermediate tables, row keys, checked broadcasts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipewatch.sources.paths import fresh_path

# Rows of a few numbers that may be broadcast: about 16 MB.
BROADCAST_ROWS = 500_000


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read again.

    Cuts lineage: a lost executor costs only the running stage. The files go when the session ends.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already stored, few narrow columns), marked for broadcast only if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


BATCH_BYTES = 4 << 20


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, whose texts are about to go to Python: batches hold few megabytes, however long the texts.

    Workers live as long as the session and keep what they once needed, so the setting is the
    session's; a smaller one stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.fullmatch(r"(\d+)b?", conf.get(key, None) or "")
    if not found or int(found[1]) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def id_bucket(column: str, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(parts))
