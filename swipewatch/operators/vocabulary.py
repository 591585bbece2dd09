"""One slot per category for columns of any number of categories.

The encoder of ``encode.py`` keeps categories on the driver and in the model, which suits some thousands. Here a vocabulary
is a table: the different values are dealt by ranges and written once, so that a number is the place within its range
plus the sizes of the ranges before, of which there are as many as partitions. Rows get their numbers by joins, and a
row's slots are put together from these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import fresh_path
from .rolling import quoted


def vocabulary(df: DataFrame, column: str, path: str | None = None) -> DataFrame:
    """(value, number) of the known values of a column as text, numbered from 0 in ascending order; stored.

    A table of the values is kept at ``path`` (default: for this session).
    """
    values = df.select(F.col(quoted(column)).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    path = path or fresh_path(df.sparkSession, "vocabulary")
    # ranges come from a sample, so they are written before they are counted
    values.repartitionByRange("value").withColumn("range", F.spark_partition_id()).write.mode("overwrite").parquet(f"{path}/ranges")
    ranges = df.sparkSession.read.parquet(f"{path}/ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n")).coalesce(1)
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("value")) - 1
    numbered = ranges.join(F.broadcast(starts), "range").select("value", (F.col("start") + place).alias("number"))
    numbered.write.mode("overwrite").parquet(f"{path}/numbers")
    return df.sparkSession.read.parquet(f"{path}/numbers")


def one_hot_slots(df: DataFrame, vocabularies: dict, output: str = "slots") -> tuple:
    """(``df`` with the ascending slots of its categories as an array, number of all slots).

    ``vocabularies`` gives a :func:`vocabulary` for each column; a column's slots follow those of the columns before it. Values
    that are null or not in the vocabulary have no slot.
    """
    start, out, made = 0, df, []
    for n, (column, known) in enumerate(vocabularies.items()):
        slot = f"__slot{n}"
        named = known.select(F.col("value").alias(f"__value{n}"), (F.col("number") + start).alias(slot))
        # hot values are split by Spark where it shuffles; a small vocabulary is broadcast by its stored size
        out = out.join(named, F.col(quoted(column)).cast("string") == F.col(f"__value{n}"), "left").drop(f"__value{n}")
        start += known.count()
        made.append(slot)
    slots = F.array_compact(F.array(*made)) if made else F.array().cast("array<bigint>")
    return out.withColumn(output, slots).drop(*made), start
