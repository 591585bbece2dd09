"""CSV in, tables out."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import exists, fresh_path, remove
from .schemas import TRANSACTIONS

log = logging.getLogger(__name__)

# What to do when the table exists, and Spark's word for it.
SAVE_MODES = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}

CORRUPT = "_corrupt_record"


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = TRANSACTIONS,
    on_bad_row: str = "fail",
    **options,
) -> DataFrame:
    """Scan a CSV file, folder or glob with a header.

    ``on_bad_row``: ``fail`` ends the job at the first row that does not fit the schema;
    ``keep`` reads what it can and puts the raw text of bad rows in ``_corrupt_record``
    (see :func:`quarantine`). ``schema=None`` infers the types, at the cost of another scan.
    """
    if on_bad_row not in ("fail", "keep"):
        raise ValueError("on_bad_row must be 'fail' or 'keep'")
    if not exists(spark, path):
        raise FileNotFoundError(f"File not found: {path}")
    if not spark.read.text(path).limit(1).count():
        # Fixed value: the message of this error
        raise ValueError(f"Empty data file: {path}")
    reader = spark.read.option("header", True).options(**options)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    if on_bad_row == "fail":
        return reader.option("mode", "FAILFAST").option("enforceSchema", False).schema(schema).csv(path)
    kept = schema.add(CORRUPT, T.StringType()) if CORRUPT not in schema.names else schema
    return (
        reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(kept).csv(path)
    )


def quarantine(df: DataFrame) -> tuple:
    """Split a ``keep`` scan into ``(good, bad)`` rows.

    The scan is written once under the shared folder and both parts read that copy: a CSV scan
    alone cannot be asked for its bad rows only.
    """
    path = fresh_path(df.sparkSession, "scan")
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    bad = F.col(CORRUPT).isNotNull()
    return kept.filter(~bad).drop(CORRUPT), kept.filter(bad)


def write_table(df: DataFrame, path: str, if_exists: str = "append", partition_by=(), fmt: str = "parquet") -> bool:
    """Write to a table folder; an empty frame is skipped. Returns whether anything was written."""
    if not path:
        raise ValueError("a table path must be given")
    if if_exists not in SAVE_MODES:
        raise ValueError(f"if_exists must be one of {sorted(SAVE_MODES)}")
    if df.isEmpty():
        log.warning("nothing to write to %s", path)
        return False
    df.write.mode(SAVE_MODES[if_exists]).partitionBy(*partition_by).format(fmt).save(path)
    return True


def write_jdbc(df: DataFrame, options: dict, if_exists: str = "append", batch_rows: int = 10_000) -> bool:
    """Write to a database table in batches; ``options`` come from :func:`jdbc_options`."""
    if if_exists not in SAVE_MODES:
        raise ValueError(f"if_exists must be one of {sorted(SAVE_MODES)}")
    if df.isEmpty():
        log.warning("nothing to write")
        return False
    df.write.format("jdbc").options(**options).option("batchsize", batch_rows).mode(SAVE_MODES[if_exists]).save()
    return True


def ingest(
    spark: SparkSession,
    csv_path: str,
    table_path: str,
    if_exists: str = "append",
    schema: T.StructType | None = TRANSACTIONS,
    partition_by_day: bool = False,
    time: str = "transaction_date",
    key: str | None = None,
) -> bool:
    """Scan a CSV once and write it as a table, optionally with one partition per day.

    With ``key`` an append is repeatable: rows whose key the table has already replace those, the
    latest by ``time`` of several stays, and rows without a key are added unless the very same
    row is there (see ``quality.merge_append``). Of a table partitioned by day only the days that
    are touched are rewritten.
    """
    df = read_csv(spark, csv_path, schema)
    if key is not None and if_exists == "append" and exists(spark, table_path):
        return _append_by_key(spark, df, table_path, key, time, partition_by_day)
    if partition_by_day:
        # rebalance: few files per day, while a busy day is still split over several tasks
        df = df.withColumn("day", F.to_date(time)).hint("rebalance", "day")
        return write_table(df, table_path, if_exists, ["day"])
    return write_table(df, table_path, if_exists)


def _append_by_key(spark, df: DataFrame, table_path: str, key: str, time: str, by_day: bool) -> bool:
    from ..operators.quality import merge_append

    if df.isEmpty():
        log.warning("nothing to write to %s", table_path)
        return False
    table = spark.read.parquet(table_path)
    if by_day:
        df = df.withColumn("day", F.to_date(time))
        # days of the new rows, and of the rows that they replace
        new_days = df.select("day")
        old_days = table.join(df.select(key).distinct(), key, "left_semi").select("day")
        days = new_days.union(old_days).distinct()
        # a row without time belongs to the null day
        touched = table.join(days.select(F.col("day").alias("__day")), F.col("day").eqNullSafe(F.col("__day")), "left_semi")
    else:
        touched = table
    # rewritten beside the table first: Spark can't overwrite what it reads
    path = fresh_path(spark, "merged")
    merge_append(touched, df.select(*table.columns), key, (time,)).write.parquet(path)
    merged = spark.read.schema(table.schema).parquet(path)
    if not by_day:
        merged.write.mode("overwrite").parquet(table_path)
        return True
    # days that have lost all their rows to other days; found before any file of the table changes
    gone = days.join(merged.select("day").distinct(), "day", "left_anti").filter("day IS NOT NULL")
    gone = [r["day"] for r in gone.collect()]  # at most the touched days
    merged.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "day"
    ).parquet(table_path)
    for day in gone:
        remove(spark, f"{table_path}/day={day}")
    return True


def save_snapshot(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a whole-table snapshot as CSV with header, or as Parquet."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    else:
        writer.format(fmt).save(path)


def jdbc_options(config: dict, table: str, partition: tuple | None = None, dialect: str = "postgresql") -> dict:
    """Reader or writer options from ``user, password, host, port, database``.

    Credentials are options of their own, never part of the address. ``partition`` is
    ``(column, low, high, parts)`` for a parallel read.
    """
    missing = [k for k in ("user", "password", "host", "port", "database") if k not in config]
    if missing:
        raise KeyError(f"database settings lack {missing}")
    for part in ("host", "database"):
        if not str(config[part]) or set(str(config[part])) & set("/?#&;@ "):
            raise ValueError(f"unusable {part} in the database settings")
    options = {
        "url": f"jdbc:{dialect}://{config['host']}:{int(config['port'])}/{config['database']}",
        "user": str(config["user"]),
        "password": str(config["password"]),
        "dbtable": table,
        "pushDownPredicate": "true",
    }
    if partition:
        column, low, high, parts = partition
        options.update(
            partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)
        )
    return options


def read_jdbc(spark: SparkSession, config: dict, table: str, partition: tuple | None = None) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(config, table, partition)).load()
