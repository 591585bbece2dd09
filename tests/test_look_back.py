"""Rows that are only looked back to are summed up, not rolled again; the features equal those of one run over all rows."""

import pytest
from pyspark.sql import functions as F

from swipewatch.config import ScalePolicy, TxnConfig
from swipewatch.operators.features import add_features, summarize_users

DAY = 86_400_000_000


@pytest.mark.parametrize("policy", [ScalePolicy(), ScalePolicy(max_group_rows=40)])
@pytest.mark.parametrize("delay", [None, "2h"])
def test_past_rows_as_totals(spark, policy, delay):
    cfg = TxnConfig(windows=("1h", "24h", "7d"), label_delay=delay)
    t = spark.range(400).selectExpr(
        "id AS transaction_id",
        "IF(id % 31 = 0, NULL, id % 3) AS user_id",
        "IF(id % 29 = 0, NULL, id % 2) AS merchant_id",
        # some leave a window at the very instant at which another row comes
        "timestamp_seconds(id div 2 * 1800) AS transaction_date",
        "IF(id % 13 = 0, NULL, round(pmod(xxhash64(id), 10000) / 100, 2)) AS amount",
        "cast(id % 7 = 0 AS int) AS fraud",
    )
    since = 2 * DAY
    whole = add_features(t, cfg, ("user", "merchant"), policy)
    late = F.coalesce(F.unix_micros("transaction_date") >= since, F.lit(True))
    here, past = t.filter(late), t.filter(~late)
    found = add_features(here, cfg, ("user", "merchant"), policy, summarize_users(past, cfg), past, since)

    def rows(df):
        return [[round(v, 6) if isinstance(v, float) else v for v in r] for r in df.orderBy("transaction_id").collect()]

    assert found.columns == whole.columns
    assert rows(found) == rows(whole.filter(late))
