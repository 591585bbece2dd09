"""Schemas of the stored tables."""

from pyspark.sql import types as T

TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("merchant_id", T.LongType()),
        T.StructField("transaction_date", T.TimestampType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("fraud", T.IntegerType()),
    ]
)
