"""Named queries over the stored tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipewatch import ScalePolicy, TxnConfig, jobs
from swipewatch.functions.scalars import as_timestamp, binarize, rule_score
from swipewatch.operators import (
    clean,
    distinct,
    encode,
    features,
    metrics,
    models,
    monitor,
    moving,
    order_stats,
    profile,
    quality,
    series,
    split,
    totals,
    trees,
    vocabulary,
)
from swipewatch.plans.ranks import quantiles
from swipewatch.sources import demo, history, ingest, retrieval, stored
from swipewatch.sources.paths import fresh_path
from swipewatch.sources.schemas import TRANSACTIONS
from swipewatch.streaming import alerts
from swipewatch.streaming import jobs as streaming

QUERIES = {}

# small enough that busy keys of the test tables take the chunked plans
SPLIT_KEYS = ScalePolicy(max_group_rows=1500, exact_sort_rows=4000)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6, exact=()) -> DataFrame:
    """Doubles rounded, timestamps as wall-clock values, so that engines can be compared.

    Columns in ``exact`` come from whole numbers by the same divisions everywhere; they stay.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType) and f.name not in exact:
            c = F.round(c, digits) + F.lit(0.0)  # no negative zero
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def _features(spark, folder, families, policy=None, **cfg):
    t = demo.transactions(spark, folder)
    made = features.add_features(t, TxnConfig(**cfg), families, policy or ScalePolicy())
    return _as_doubles(made, t.columns)


def _as_doubles(made, inputs):
    """Id and features; counts that may be null as doubles."""
    names = [c for c in made.columns if c not in inputs and c != "transaction_id"]
    out = made.select("transaction_id", *[F.col(c).cast("double").alias(c) for c in names])
    return rounded(out, exact=[c for c in names if "zscore" not in c])


# --- rolling features ---------------------------------------------------------------


@query
def transaction_features(spark, folder):
    return _features(spark, folder, ("user", "merchant", "currency", "status"))


@query
def user_rolling(spark, folder):
    out = _features(spark, folder, ("user",))
    return out.drop("user_amount_zscore", "user_time_since_last_txn")


@query
def user_recency(spark, folder):
    return _features(spark, folder, ("user",), windows=()).select("transaction_id", "user_time_since_last_txn")


@query
def user_zscore(spark, folder):
    return _features(spark, folder, ("user",), windows=()).select("transaction_id", "user_amount_zscore")


@query
def merchant_rolling(spark, folder):
    out = _features(spark, folder, ("merchant",))
    return out.select(*[c for c in out.columns if "fraud_rate" not in c])


@query
def merchant_fraud_rate(spark, folder):
    out = _features(spark, folder, ("merchant",))
    return out.select("transaction_id", *[c for c in out.columns if "fraud_rate" in c])


@query
def merchant_fraud_rate_delayed(spark, folder):
    out = _features(spark, folder, ("merchant",), windows=("7d",), label_delay="24h")
    return out.select("transaction_id", *[c for c in out.columns if "fraud_rate" in c])


@query
def currency_rolling(spark, folder):
    return _features(spark, folder, ("currency",))


@query
def status_rolling(spark, folder):
    return _features(spark, folder, ("status",))


@query
def currency_rolling_split(spark, folder):
    return _features(spark, folder, ("currency",), SPLIT_KEYS)


@query
def rolling_tied_times(spark, folder):
    """Many rows at the same instant: orders carry dates only; customers are the users."""
    orders = demo.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("transaction_date"),
        F.col("o_totalprice").alias("amount"),
    )
    out = features.add_features(orders, TxnConfig(windows=("30d",)), ("user", "status"), SPLIT_KEYS)
    return _as_doubles(out, orders.columns)


def _moving(spark, folder, key, outputs, policy=None, windows=TxnConfig().windows, gaps=False):
    """Id and the named aggregates of the amounts over the windows before each row."""
    source = demo.transactions_with_gaps if gaps else demo.transactions
    base = features.prepare(source(spark, folder), TxnConfig())
    columns = [moving.Moving("__amount", outputs)]
    kw = {"policy": policy or ScalePolicy(), "keep": ["transaction_id"]}
    out = moving.moving(base, key, "__time_us", "__tie", windows, columns, **kw)
    # amounts have two digits, so means may lie halfway between two roundings: they are moved off it
    return rounded(out.select("transaction_id", *[(F.col(c) + OFF_HALVES).alias(c) for c in out.columns[1:]]))


OFF_HALVES = 3e-8
EXTREMES = {"min": "amount_min", "max": "amount_max", "first": "amount_first", "last": "amount_last"}
MOMENTS = {"mean": "amount_mean", "std": "amount_std", "var": "amount_var", "skew": "amount_skew", "kurt": "amount_kurt"}


@query
def rolling_extremes(spark, folder):
    return _moving(spark, folder, "user_id", EXTREMES)


@query
def rolling_extremes_split(spark, folder):
    return _moving(spark, folder, "currency", EXTREMES, SPLIT_KEYS, gaps=True)


@query
def rolling_moments(spark, folder):
    return _moving(spark, folder, "user_id", MOMENTS, gaps=True)


@query
def rolling_moments_split(spark, folder):
    return _moving(spark, folder, "currency", MOMENTS, SPLIT_KEYS)


def _distinct_merchants(spark, folder, key, policy=None):
    base = features.prepare(demo.transactions(spark, folder), TxnConfig())
    out = distinct.rolling_distinct(
        base, key, "merchant_id", "__time_us", "__tie", TxnConfig().windows, "merchants", policy or ScalePolicy(), ["transaction_id"]
    )
    return out.select("transaction_id", *[F.col(c).cast("double").alias(c) for c in out.columns[1:]])


@query
def rolling_distinct(spark, folder):
    return _distinct_merchants(spark, folder, "user_id")


@query
def rolling_distinct_split(spark, folder):
    return _distinct_merchants(spark, folder, "currency", SPLIT_KEYS)


def _quantiles(spark, folder, key, policy=None):
    base = features.prepare(demo.transactions_with_gaps(spark, folder), TxnConfig())
    probs = {"amount_median": 0.5, "amount_p90": 0.9}
    out = order_stats.rolling_quantiles(
        base, key, "__amount", "__time_us", TxnConfig().windows, probs, policy or ScalePolicy(), ["transaction_id"]
    )
    return rounded(out.select("transaction_id", *[(F.col(c) + OFF_HALVES).alias(c) for c in out.columns[1:]]))


@query
def rolling_median(spark, folder):
    return _quantiles(spark, folder, "user_id")


@query
def rolling_median_split(spark, folder):
    return _quantiles(spark, folder, "currency", SPLIT_KEYS)


@query
def point_in_time_features(spark, folder):
    """All features of the last week's rows, given the stored history before it and those rows alone."""
    t = demo.transactions_with_gaps(spark, folder)
    week = t.agg(F.expr("max(transaction_date) - INTERVAL 7 DAYS").alias("cut")).first()["cut"]
    stored = history.StoredHistory(spark, fresh_path(spark, "history"))
    stored.append(t.where(F.col("transaction_date") < F.lit(week)))
    made = history.features_from_history(t.where(F.col("transaction_date") >= F.lit(week)), stored)
    return _as_doubles(made, t.columns)


# --- series -------------------------------------------------------------------------


@query
def moving_average(spark, folder):
    out = series.moving_average(demo.transactions(spark, folder), "user_id", "transaction_date", "amount", 5)
    return rounded(out.select("transaction_id", "moving_average"))


@query
def moving_average_split(spark, folder):
    out = series.moving_average(
        demo.transactions(spark, folder), "currency", "transaction_date", "amount", 20, policy=SPLIT_KEYS
    )
    return rounded(out.select("transaction_id", "moving_average"))


@query
def ema(spark, folder):
    out = series.exponential_average(demo.transactions(spark, folder), "user_id", "transaction_date", "amount", 0.3)
    return rounded(out.select("transaction_id", "ema"))


@query
def ema_split(spark, folder):
    out = series.exponential_average(
        demo.transactions(spark, folder), "currency", "transaction_date", "amount", 0.3, policy=SPLIT_KEYS
    )
    return rounded(out.select("transaction_id", "ema"))


@query
def ema_last(spark, folder):
    out = series.exponential_average(demo.transactions(spark, folder), "user_id", "transaction_date", "amount", 0.3)
    return rounded(series.last_of_series(out, "user_id", "transaction_date", "transaction_id", "ema", "ema"))


@query
def rsi(spark, folder):
    out = series.relative_strength(demo.transactions(spark, folder), "user_id", "transaction_date", "amount", 14)
    return rounded(out.select("transaction_id", "rsi"))


@query
def rsi_split(spark, folder):
    out = series.relative_strength(
        demo.transactions(spark, folder), "currency", "transaction_date", "amount", 14, policy=SPLIT_KEYS
    )
    return rounded(out.select("transaction_id", "rsi"))


@query
def rsi_last(spark, folder):
    out = series.relative_strength(demo.transactions(spark, folder), "user_id", "transaction_date", "amount", 14)
    return rounded(series.last_of_series(out, "user_id", "transaction_date", "transaction_id", "rsi", "rsi"))


# --- cleaning -----------------------------------------------------------------------


@query
def amount_clean(spark, folder):
    out = clean.clean_amount(demo.transactions_with_gaps(spark, folder))
    return rounded(out.select("transaction_id", "amount"))


@query
def amount_stats(spark, folder):
    return rounded(clean.value_stats(demo.transactions_with_gaps(spark, folder), "amount"))


@query
def remove_missing(spark, folder):
    return clean.remove_missing(demo.transactions_with_gaps(spark, folder), "amount").select(
        "transaction_id", "amount"
    )


@query
def remove_outliers(spark, folder):
    return clean.remove_outliers(demo.transactions_with_gaps(spark, folder), "amount").select(
        "transaction_id", "amount"
    )


@query
def remove_outliers_by_user(spark, folder):
    out = clean.remove_outliers(demo.transactions_with_gaps(spark, folder), "amount", 2.0, by="user_id")
    return out.select("transaction_id", "user_id", "amount")


@query
def binarize_scores(spark, folder):
    t = demo.transactions(spark, folder)
    return t.select("transaction_id", binarize(F.col("amount") / 100.0).alias("large"))


@query
def risk_rule(spark, folder):
    t = demo.transactions(spark, folder)
    p90 = quantiles(t, ["amount"], [0.9])["amount"][0.9]
    return rounded(t.select("transaction_id", rule_score(F.col("amount"), F.col("status"), p90).alias("score")))


@query
def drop_columns(spark, folder):
    return rounded(demo.transactions(spark, folder).drop("user_id", "merchant_id", "transaction_date", "no_such"))


@query
def parse_times(spark, folder):
    """ISO text with and without offset, another format, and text that is no time."""
    t = demo.transactions(spark, folder)
    iso = F.date_format("transaction_date", "yyyy-MM-dd HH:mm:ss")
    text = (
        F.when(F.col("transaction_id") % 13 == 0, "no time")
        .when(F.col("transaction_id") % 7 == 0, F.concat(iso, F.lit("+02:00")))
        .when(F.col("transaction_id") % 5 == 0, F.date_format("transaction_date", "dd.MM.yyyy HH:mm"))
        .otherwise(iso)
    )
    t = t.select("transaction_id", text.alias("text"))
    parsed = as_timestamp(t, "text", "null", ("dd.MM.yyyy HH:mm",))
    return t.select("transaction_id", F.coalesce(F.unix_seconds(parsed), F.lit(-1)).alias("seconds"))


@query
def label_encode(spark, folder):
    t = demo.transactions(spark, folder)
    return encode.encode_labels(t, "status", "code").select("transaction_id", "status", "code")


# --- sources and retrieval ----------------------------------------------------------


def _csv_copy(spark, folder, with_gaps=False):
    path = fresh_path(spark, "csv")
    t = demo.transactions_with_gaps(spark, folder) if with_gaps else demo.transactions(spark, folder)
    ingest.save_snapshot(t, path)
    return path


@query
def ingest_csv_scan(spark, folder):
    return rounded(ingest.read_csv(spark, _csv_copy(spark, folder, with_gaps=True)))


@query
def ingest_run(spark, folder):
    path = fresh_path(spark, "table")
    ingest.ingest(spark, _csv_copy(spark, folder), path, partition_by_day=True)
    return rounded(spark.read.parquet(path).withColumn("day", F.col("day").cast("string")))


@query
def ingest_table_modes(spark, folder):
    """Replace, then append the same rows: two rows per transaction."""
    path = fresh_path(spark, "table")
    t = demo.transactions(spark, folder)
    ingest.write_table(t, path, "fail")
    ingest.write_table(t, path, "replace")
    ingest.write_table(t, path, "append")
    return spark.read.parquet(path).groupBy("currency").agg(
        F.count("*").alias("rows"), F.countDistinct("transaction_id").alias("ids")
    )


@query
def ingest_snapshot(spark, folder):
    path = fresh_path(spark, "snapshot")
    ingest.save_snapshot(demo.transactions(spark, folder), path)
    return rounded(spark.read.schema(TRANSACTIONS).option("header", True).csv(path))


@query
def txn_date_range(spark, folder):
    t = demo.transactions(spark, folder)
    return rounded(retrieval.transactions_between(t, "2024-01-10 00:00:00", "2024-01-12 12:00:00"))


@query
def users_projection(spark, folder):
    return rounded(retrieval.all_users(demo.users(spark, folder)))


@query
def fraud_txns(spark, folder):
    return rounded(retrieval.fraud_transactions(demo.transactions(spark, folder)))


@query
def txns_by_user(spark, folder):
    return rounded(retrieval.transactions_of_user(demo.transactions(spark, folder), 7))


@query
def user_lookup(spark, folder):
    found = retrieval.find_users(demo.users(spark, folder), 11, "customer#000000005@example.com")
    return rounded(found)


# --- joins and keys -----------------------------------------------------------------


@query
def txn_user_enrich(spark, folder):
    out = quality.with_user(demo.transactions(spark, folder), demo.users(spark, folder))
    return out.select("transaction_id", "user_id", "user_name", "email")


@query
def orphan_txns(spark, folder):
    """Customers with a negative balance are taken as not registered."""
    registered = demo.table(spark, folder, "customer").filter("c_acctbal >= 0")
    known = registered.select(F.col("c_custkey").alias("user_id"))
    return quality.without_user(demo.transactions(spark, folder), known).select("transaction_id", "user_id")


@query
def pk_violations(spark, folder):
    return quality.key_violations(demo.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def dedupe_append(spark, folder):
    """Append the second half of the month again, with raised amounts."""
    t = demo.transactions(spark, folder)
    late = t.filter("transaction_date >= '2024-01-16'").withColumn("amount", F.col("amount") + 1000.0)
    return rounded(quality.merge_append(t, late).select("transaction_id", "status", "amount"))


@query
def merge_versions(spark, folder):
    """Three versions of every seventh transaction arrive out of order, some rows have no id, and all of it twice."""
    t = demo.transactions(spark, folder).select("transaction_id", "transaction_date", "amount")
    some = t.filter("transaction_id % 7 = 0")
    steps = F.explode(F.array(F.lit(2), F.lit(3), F.lit(1))).alias("step")
    late = some.select("*", steps).select(
        F.when(F.col("transaction_id") % 5 != 0, F.col("transaction_id")).alias("transaction_id"),
        (F.col("transaction_date") + F.make_dt_interval(hours="step")).alias("transaction_date"),
        (F.col("amount") + 1000.0 * F.col("step")).alias("amount"),
    )
    once = quality.merge_append(t, late)
    return rounded(quality.merge_append(once, late))


# --- totals and profiles ------------------------------------------------------------


@query
def user_totals(spark, folder):
    return rounded(totals.user_totals(demo.transactions(spark, folder)))


@query
def daily_totals(spark, folder):
    return rounded(totals.period_totals(demo.transactions(spark, folder)))


@query
def user_day_rollup(spark, folder):
    out = totals.user_day_rollup(demo.transactions(spark, folder))
    return rounded(out.withColumns({"user_id": F.coalesce("user_id", F.lit(-1)), "day": F.col("day").cast("string")}))


@query
def class_weights(spark, folder):
    return rounded(totals.class_weights(demo.transactions(spark, folder)))


@query
def aggregate_features(spark, folder):
    """Average of the named features of each user's transactions; names vary by row."""
    t = demo.transactions(spark, folder).withColumn(
        "features",
        F.map_from_arrays(
            F.array(F.lit("cents"), F.concat(F.lit("is_"), "status")), F.array(F.rint(F.col("amount") * 100), F.lit(1.0))
        ),
    )
    out = totals.average_features(t, "features", by="user_id")
    return out.select("user_id", F.explode("averages").alias("name", "average"))


@query
def aggregate_features_null_key(spark, folder):
    """Transactions without user have averages of their own."""
    t = demo.transactions(spark, folder).select(
        F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 5).alias("part"),
        F.create_map(F.concat(F.lit("in_"), "currency"), F.lit(1.0)).alias("features"),
    )
    out = totals.average_features(t, "features", by="part")
    return rounded(out.select("part", F.explode("averages").alias("name", "average")))


@query
def aggregate_features_all(spark, folder):
    t = demo.transactions(spark, folder).withColumn(
        "features",
        F.map_from_arrays(
            F.array(F.lit("cents"), F.concat(F.lit("is_"), "status")), F.array(F.rint(F.col("amount") * 100), F.lit(1.0))
        ),
    )
    return totals.average_features(t, "features").select(F.explode("averages").alias("name", "average"))


@query
def profile_nulls(spark, folder):
    return profile.null_profile(demo.transactions_with_gaps(spark, folder)).select("column", "rows", "missing")


@query
def schema_roles(spark, folder):
    return profile.null_profile(demo.transactions_with_gaps(spark, folder)).select("column", "role", "missing")


@query
def describe_amount(spark, folder):
    t = demo.transactions_with_gaps(spark, folder)
    return rounded(profile.describe(t, ["amount", "merchant_id", "fraud"]))


@query
def describe_amount_split(spark, folder):
    """The same by bracket refinement, the plan for tables too large to sort."""
    t = demo.transactions_with_gaps(spark, folder)
    return rounded(profile.describe(t, ["amount", "merchant_id", "fraud"], ScalePolicy(exact_sort_rows=300)))


@query
def corr_matrix(spark, folder):
    return rounded(profile.correlation(demo.transactions(spark, folder), ["amount", "merchant_id", "fraud"]))


@query
def histogram_amount(spark, folder):
    """Bounds from the data; the counts sum to all rows with an amount."""
    out = profile.histogram(demo.transactions_with_gaps(spark, folder), "amount", 20)
    return rounded(out.filter("bin BETWEEN 0 AND 19"))


@query
def histogram_amount_bounds(spark, folder):
    """Given bounds; what lies outside them has bins of its own."""
    out = profile.histogram(demo.transactions(spark, folder), "amount", 10, 50.0, 150.0)
    return rounded(out.select("bin", F.when(F.col("bin") >= 0, F.col("bin_start")).alias("bin_start"), "n"))


@query
def quantiles_inflated(spark, folder):
    """Two values hold most rows, with a continuous middle; few rows are settled by counting."""
    t = demo.transactions(spark, folder)
    x = F.when(F.col("transaction_id") % 10 < 6, 0.0).when(F.col("transaction_id") % 10 < 9, 1.0)
    t = t.select(x.alias("x"), F.col("amount"), F.col("transaction_id").alias("n")).withColumn(
        "x", F.coalesce("x", F.col("amount") / 1000.0)
    )
    probs = [0.0, 0.3, 0.599, 0.61, 0.65, 0.699, 0.7, 0.9, 1.0]
    found = quantiles(t, ["x", "amount"], probs, ScalePolicy(exact_sort_rows=50))
    rows = [(c, p, float(v)) for c, of in found.items() for p, v in of.items()]
    return rounded(spark.createDataFrame(rows, "column string, p double, value double"))


@query
def boxplot_stats(spark, folder):
    return rounded(profile.box_stats(demo.transactions_with_gaps(spark, folder), ["amount", "merchant_id"]))


@query
def by_label_summary(spark, folder):
    return rounded(profile.by_label(demo.transactions(spark, folder), "fraud", ["amount", "merchant_id"]))


# --- order and splits ---------------------------------------------------------------


@query
def sorted_txns(spark, folder):
    t = demo.transactions(spark, folder)
    out = t.orderBy(F.col("transaction_date").asc_nulls_last(), "transaction_id")
    return rounded(out.select("transaction_id", "transaction_date"))


@query
def time_split(spark, folder):
    return split.time_split(demo.transactions(spark, folder)).select("transaction_id", "is_train")


@query
def time_split_refined(spark, folder):
    """The cut found by bracket refinement, on a table with many ties."""
    orders = demo.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_orderdate").cast("timestamp").alias("transaction_date")
    )
    return split.time_split(orders, 0.3, policy=ScalePolicy(exact_sort_rows=200))


@query
def time_split_repeated(spark, folder):
    """Order lines as transactions: ids repeat, times tie; sizes are exact all the same."""
    lines = demo.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"),
        F.col("l_linenumber").alias("line"),
        F.date_trunc("year", F.col("l_shipdate").cast("timestamp")).alias("transaction_date"),
    )
    by_time = split.time_split(lines, 0.25).groupBy("is_train").agg(F.count("*").alias("rows"))
    at_random = split.random_split(lines, 0.2).groupBy("is_train").agg(F.count("*").alias("rows"))
    return by_time.withColumn("kind", F.lit("time")).unionByName(at_random.withColumn("kind", F.lit("random")))


@query
def time_split_summary(spark, folder):
    cut = split.time_split(demo.transactions(spark, folder))
    return rounded(
        cut.groupBy("is_train").agg(
            F.count("*").alias("rows"),
            F.sum("fraud").alias("frauds"),
            F.min("transaction_date").alias("first"),
            F.max("transaction_date").alias("last"),
        )
    )


@query
def random_split(spark, folder):
    return split.random_split(demo.transactions(spark, folder)).select("transaction_id", "is_train")


@query
def stratified_split(spark, folder):
    t = demo.transactions(spark, folder)
    return split.random_split(t, label=split.stratify_by(t, "fraud")).select("transaction_id", "fraud", "is_train")


# --- metrics ------------------------------------------------------------------------


def _scored(spark, folder):
    """Transactions with a rule score (few distinct values, many ties) and a prediction."""
    t = demo.transactions(spark, folder)
    score = rule_score(F.col("amount"), F.col("status"), 115.0)
    return t.select(
        "transaction_id",
        "transaction_date",
        F.col("fraud").alias("label"),
        score.alias("score"),
        binarize(score, 0.09).alias("prediction"),
    )


def _scored_fine(spark, folder):
    """Transactions scored by amount: as many distinct scores as amounts."""
    t = demo.transactions(spark, folder)
    return t.select(
        F.col("fraud").alias("label"), F.col("amount").alias("score"), binarize(F.col("amount"), 115.0).alias("prediction")
    )


def _scored_documents(spark, folder):
    labels, docs = demo.table(spark, folder, "labels"), demo.table(spark, folder, "documents")
    return labels.join(docs, "doc_id").select(
        F.col("toxic").alias("label"), F.col("n_chars").cast("double").alias("score"),
        F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("prediction"),
    )


@query
def eval_report(spark, folder):
    return rounded(metrics.report(_scored(spark, folder)))


@query
def eval_report_documents(spark, folder):
    return rounded(metrics.report(_scored_documents(spark, folder)))


@query
def roc_auc(spark, folder):
    return rounded(metrics.ranking_metrics(_scored_fine(spark, folder)).select("roc_auc"))


@query
def average_precision(spark, folder):
    return rounded(metrics.ranking_metrics(_scored_fine(spark, folder)).select("average_precision"))


@query
def ranking_split(spark, folder):
    """The same metrics with the distinct scores cut into ordered chunks."""
    return rounded(metrics.ranking_metrics(_scored_fine(spark, folder), policy=ScalePolicy(max_group_rows=100)))


@query
def roc_curve(spark, folder):
    """The origin has no threshold here: infinity is no SQL literal everywhere."""
    out = metrics.roc_curve(_scored(spark, folder))
    return rounded(out.withColumn("threshold", F.when(F.abs("threshold") < float("inf"), F.col("threshold"))))


@query
def roc_corners(spark, folder):
    """The curve without the inner points of its straight runs, found in chunks of the scores."""
    out = metrics.corners(metrics.roc_curve(_scored_fine(spark, folder)), ScalePolicy(max_group_rows=100))
    return rounded(out.withColumn("threshold", F.when(F.abs("threshold") < float("inf"), F.col("threshold"))))


@query
def sample_by_label(spark, folder):
    """Forty rows of each class for the scatter and pair plots."""
    out = profile.sample_by_label(demo.transactions(spark, folder), "fraud", 40, "transaction_id")
    return rounded(out.select("transaction_id", "fraud", "amount", "currency"))


@query
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(_scored(spark, folder))


def _scored_kinds(spark, folder):
    """Three classes and rows without label or prediction."""
    t = demo.transactions(spark, folder)
    return t.select(
        F.when(F.col("transaction_id") % 11 != 0, F.col("merchant_id") % 3).alias("label"),
        F.when(F.col("transaction_id") % 13 != 0, F.col("transaction_id") % 4).alias("prediction"),
    )


@query
def confusion_matrix_classes(spark, folder):
    return metrics.confusion_matrix(_scored_kinds(spark, folder))


@query
def confusion_matrix_classes_norm(spark, folder):
    return rounded(metrics.confusion_matrix(_scored_kinds(spark, folder), normalize=True))


@query
def confusion_matrix_norm(spark, folder):
    return rounded(metrics.confusion_matrix(_scored(spark, folder), normalize=True))


# --- monitoring ---------------------------------------------------------------------


@query
def monitor_windows(spark, folder):
    return monitor.window_activity(demo.transactions(spark, folder))


@query
def monitor_alerts(spark, folder):
    return monitor.alerts(monitor.window_activity(demo.transactions(spark, folder)), 0.15)


@query
def psi_drift(spark, folder):
    t = demo.transactions(spark, folder)
    now = F.col("transaction_date") >= F.lit("2024-01-16").cast("timestamp")
    return rounded(monitor.stability_index(t, ["amount", "merchant_id", "user_id"], now))


@query
def drift_any_periods(spark, folder):
    """Two periods compared from stored day sketches alone; the index must be close to the exact one of the rows."""
    t = demo.transactions(spark, folder)
    names, path = ["amount", "merchant_id", "user_id"], fresh_path(spark, "sketches")
    monitor.day_sketches(t, names).write.partitionBy("day").parquet(path)
    cut = F.lit("2024-01-16").cast("date")
    told = monitor.drift_between(spark.read.parquet(path), F.col("day") < cut, F.col("day") >= cut)
    exact = monitor.stability_index(t, names, F.col("transaction_date") >= cut.cast("timestamp")).withColumnRenamed("psi", "exact")
    close = F.coalesce(F.abs(F.col("psi") - F.col("exact")) <= 0.01 + 0.1 * F.col("exact"), F.lit(False))
    return told.join(exact, "feature").select("feature", "n_base", "n_now", close.alias("is_close"))


@query
def daily_metrics(spark, folder):
    out = monitor.metrics_per_day(_scored(spark, folder))
    return rounded(out.withColumn("day", F.col("day").cast("string")))


@query
def stream_performance(spark, folder):
    """Daily metrics of a stream of scores whose labels come hours to nine days later; seven days are waited for."""
    scored, root = _scored(spark, folder), fresh_path(spark, "performance")
    scored.drop("label").write.parquet(f"{root}/scores")
    later = F.make_dt_interval(hours=F.col("transaction_id") % 216)
    labels = scored.select("transaction_id", "label", (F.col("transaction_date") + later).alias("labelled_at"))
    labels.write.parquet(f"{root}/labels")
    streams = [streaming.read_stream(spark, f"{root}/{n}", spark.read.parquet(f"{root}/{n}").schema) for n in ("scores", "labels")]
    streaming.labelled_stream(*streams, f"{root}/joined", f"{root}/checkpoint").awaitTermination()
    judged = spark.read.parquet(f"{root}/joined").where("label IS NOT NULL")
    out = monitor.metrics_per_day(judged)
    return rounded(out.withColumn("day", F.col("day").cast("string")))


# --- encoding and models ------------------------------------------------------------


def _train_part(spark, folder):
    t = demo.transactions_with_gaps(spark, folder).withColumn(
        "currency", F.when(F.col("transaction_id") % 11 != 0, F.col("currency"))
    )
    return t.select("transaction_id", "amount", "merchant_id", "currency", "status")


@query
def impute_median(spark, folder):
    t = _train_part(spark, folder)
    rules, _ = encode.fit_numeric(t, ["amount", "merchant_id"])
    made = encode.numeric_expressions(t, rules, impute_only=True)
    return rounded(t.selectExpr("transaction_id", *[f"{x} AS {n}" for n, x in made]))


@query
def scale_numeric(spark, folder):
    t = _train_part(spark, folder)
    rules, _ = encode.fit_numeric(t, ["amount", "merchant_id"])
    return rounded(t.selectExpr("transaction_id", *[f"{x} AS {n}" for n, x in encode.numeric_expressions(t, rules)]))


@query
def impute_mode(spark, folder):
    t = _train_part(spark, folder)
    fill = encode.most_frequent(t, ["currency"])["currency"]
    return t.select("transaction_id", F.coalesce("currency", F.lit(fill)).alias("currency"))


@query
def one_hot(spark, folder):
    """Fitted on the approved and reversed rows; the declined status is unseen."""
    t = _train_part(spark, folder)
    encoder, names = encode.fit_encoder(t.filter("status <> 'declined'"), ["currency", "status"])
    slots = vector_to_array(F.col("features"))
    return encoder.transform(t).select(
        "transaction_id", *[slots[n].alias(name.lower()) for n, name in enumerate(names)]
    )


def _prepared(spark, folder, **kw):
    return jobs.preprocess(demo.transactions_with_gaps(spark, folder), **kw)


@query
def preprocess_features(spark, folder):
    """The encoded rows of both parts, every slot of the vector as a column."""
    done = _prepared(spark, folder)
    both = done.train.withColumn("part", F.lit("train")).unionByName(done.test.withColumn("part", F.lit("test")))
    slots = vector_to_array(F.col("features"))
    named = [slots[n].alias(name.lower()) for n, name in enumerate(done.names)]
    return rounded(both.select("transaction_id", "part", "label", *named), 5)


@query
def feature_dataset(spark, folder):
    """The stored feature set of the training rows, read back."""
    path = fresh_path(spark, "dataset")
    done = _prepared(spark, folder)
    stored.write_features(done.train, path)
    slots = vector_to_array(F.col("features"))
    amount = slots[done.names.index("num__amount")]
    found = stored.read_features(spark, path)
    return rounded(found.select("transaction_id", "label", F.size(slots).alias("width"), amount.alias("amount")))


@query
def preprocess_metadata(spark, folder):
    """The stored settings; of the learned amount rule its threshold, of the names their number."""
    path = fresh_path(spark, "settings")
    stored.write_metadata(spark, _prepared(spark, folder).settings, path)
    found = stored.read_metadata(spark, path)
    found["amount_rule"] = found["amount_rule"]["threshold"]
    found["feature_names"] = len(found["feature_names"])
    found["roles"] = ",".join(sorted(str(v) for v in found["roles"].values() if isinstance(v, str)))
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(found.items())], "setting string, value string")


@query
def wide_one_hot(spark, folder):
    """Slots of a column with as many categories as rows and of two small ones; vocabularies are tables."""
    t = demo.transactions(spark, folder).withColumn("name", F.concat(F.lit("t"), F.col("transaction_id").cast("string")))
    known = {c: vocabulary.vocabulary(t, c) for c in ("name", "currency", "merchant_id")}
    out, width = vocabulary.one_hot_slots(t, known)
    return out.select("transaction_id", F.array_join(F.col("slots").cast("array<string>"), ",").alias("slots"), F.lit(width).alias("width"))


# the models of rf_scores, gbt_scores, training_metrics, score_new_table and the like are fitted on all training rows;
# param_grid and stream_scores fit on at most so many
FIT_ROWS = 2_000
_FITTED = {}


def _trained(spark, folder, choice):
    """Prepared rows and the model of one kind with its scores: fitted once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FITTED:
        _FITTED[key] = (_prepared(spark, folder), {})
    done, made = _FITTED[key]
    if choice not in made:
        for name, (model, scores) in jobs.train_models(done.train, done.test, choice).items():
            path = fresh_path(spark, "scores")
            scores.write.parquet(path)
            made[choice] = (name, model, spark.read.parquet(path))
    return done, made[choice]


def _learned(scored):
    """Whether a model tells the classes of the rows apart that it was fitted on; one that says the same of all does not."""
    # written once: the area reads the scores several times
    path = fresh_path(scored.sparkSession, "fitted_scores")
    scored.select("label", "score").write.parquet(path)
    found = metrics.ranking_metrics(scored.sparkSession.read.parquet(path)).first()["roc_auc"]
    return found is not None and found > 0.6


def _judged(scores, learned=None):
    """What is determined about scores: whose they are, that they are chances, what follows from them, that they tell something.

    The last only where ``learned`` is given.
    """
    return scores.select(
        "transaction_id",
        F.col("label").cast("int").alias("label"),
        F.col("score").between(0, 1).alias("is_chance"),
        ((F.col("score") > 0.5) == (F.col("prediction") == 1)).alias("follows"),
        *([] if learned is None else [F.lit(learned).alias("learned")]),
    )


@query
def rf_scores(spark, folder):
    done, (_, model, scores) = _trained(spark, folder, "rf")
    return _judged(scores, _learned(models.score(model, done.train)))


@query
def gbt_scores(spark, folder):
    done, (_, model, scores) = _trained(spark, folder, "gbt")
    return _judged(scores, _learned(models.score(model, done.train)))


@query
def hist_boosting_scores(spark, folder):
    """Second-order trees from histograms; a quarter of the fitted rows judges by average precision when to stop."""
    done, _ = _trained(spark, folder, "rf")
    settings = trees.BoostSettings(rounds=12, depth=3, rate=0.3, bins=32, patience=6, check_every=3)
    model = trees.boosted(done.train, settings, valid=F.pmod(F.xxhash64("transaction_id"), F.lit(4)) == 0)
    return _judged(model.score(done.test), _learned(model.score(done.train)))


@query
def balanced_forest_scores(spark, folder):
    """A forest with a Poisson sample and class weights of its own for each tree."""
    done, _ = _trained(spark, folder, "rf")
    model = trees.balanced_forest(done.train, trees.ForestSettings(trees=20, depth=6, bins=32))
    return _judged(model.score(done.test), _learned(model.score(done.train)))


@query
def feature_importance(spark, folder):
    """Every slot by name, and that the importances are shares of one."""
    done, (_, model, _) = _trained(spark, folder, "rf")
    listed = models.feature_importance(model, done.names)
    total = round(float(model.featureImportances.toArray().sum()), 6)
    return listed.select(
        F.lower("feature").alias("feature"), F.col("importance").between(0, 1).alias("is_share"), F.lit(total).alias("total")
    )


@query
def model_roundtrip(spark, folder):
    done, (_, model, scores) = _trained(spark, folder, "rf")
    path = fresh_path(spark, "model")
    stored.save_model(model, path)
    again = models.score(stored.load_model(spark, path), done.test).select("transaction_id", F.col("score").alias("again"))
    return scores.join(again, "transaction_id").agg(
        F.count("*").alias("rows"), F.max(F.abs(F.col("score") - F.col("again"))).alias("difference")
    )


@query
def training_metrics(spark, folder):
    """Metrics of both models from their stored scores, written under one run name twice."""
    path, rows = fresh_path(spark, "metrics"), None
    for choice in ("rf", "gbt"):
        name, _, scores = _trained(spark, folder, choice)[1]
        found = models.model_metrics(scores, name)
        rows = found if rows is None else rows.unionByName(found)
    for _ in range(2):
        stored.write_metrics(rows, path, "run")
    again = None
    for choice in ("rf", "gbt"):
        name, _, scores = _trained(spark, folder, choice)[1]
        found = _metrics_anew(scores).withColumn("model", F.lit(name))
        again = found if again is None else again.unionByName(found)
    told = stored.read_metrics(spark, path, "run").join(again, ["model", "metric"], "left")
    same = F.coalesce(F.abs(F.col("value") - F.col("anew")) < 1e-9, F.lit(False))
    return told.select("model", "metric", F.col("value").between(0, 1).alias("is_share"), same.alias("agrees"))


def _metrics_anew(scores):
    """The metrics by other formulas: ranks of the positives, and precision at each positive's score."""
    ranked = scores.selectExpr(
        "cast(label AS int) AS y", "prediction AS p", "score", "rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS low",
        "count(*) OVER (ORDER BY score DESC) AS n_from", "sum(cast(label AS int)) OVER (ORDER BY score DESC) AS y_from",
    )
    counts = ranked.selectExpr(
        "avg(cast(y = p AS double)) AS accuracy", "coalesce(try_divide(sum(y * p), sum(p)), 0D) AS precision",
        "coalesce(try_divide(sum(y * p), sum(y)), 0D) AS recall", "coalesce(try_divide(2 * sum(y * p), sum(y) + sum(p)), 0D) AS f1_score",
        "(sum(IF(y = 1, low, 0)) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS roc_auc",
        "avg(IF(y = 1, y_from / n_from, NULL)) AS average_precision",
    )
    pairs = ", ".join(f"'{n}', cast({n} AS double)" for n in counts.columns)
    return counts.selectExpr(f"stack({len(counts.columns)}, {pairs}) AS (metric, anew)")


@query
def train_text_label(spark, folder):
    """A text label: classes are learned on the training rows, stored, and used for the new table."""
    t = demo.transactions_with_gaps(spark, folder)
    t = t.withColumn("fraud", F.when(F.col("fraud") == 1, "yes").otherwise("no")).drop("merchant_id")
    root = fresh_path(spark, "text")
    t.write.parquet(f"{root}/table")
    jobs.run_preprocess(spark, f"{root}/table", f"{root}/prepared")
    settings = stored.read_metadata(spark, f"{root}/prepared/settings")
    test = stored.read_features(spark, f"{root}/prepared/test")
    return test.select("transaction_id", F.element_at(
        F.array(*[F.lit(c) for c in settings["label_classes"]]), F.col("label") + 1
    ).alias("label"))


@query
def score_new_table(spark, folder):
    """A model is trained on the month's table; another table without labels is scored with what was stored."""
    t = demo.transactions(spark, folder)
    root = fresh_path(spark, "scoring")
    t.write.parquet(f"{root}/table")
    jobs.run_preprocess(spark, f"{root}/table", f"{root}/prepared")
    train = stored.read_features(spark, f"{root}/prepared/train")
    model = jobs.train_models(train, train.limit(0), "rf")["random_forest"][0]
    stored.save_model(model, f"{root}/model")
    new = t.withColumn("transaction_id", F.col("transaction_id") + 1_000_000).drop("fraud")
    # written once: whether the scores differ is asked before they are returned
    jobs.score_table(new, f"{root}/prepared", f"{root}/model").write.parquet(f"{root}/scores")
    out = spark.read.parquet(f"{root}/scores")
    different = out.select("score").distinct().limit(2).count() > 1
    return out.select("transaction_id", F.col("score").between(0, 1).alias("is_chance"), F.lit(different).alias("learned"))


@query
def best_model(spark, folder):
    """Two rule scores as two models, compared by ranking quality."""
    coarse = models.model_metrics(_scored(spark, folder), "rule")
    fine = models.model_metrics(_scored_fine(spark, folder), "amount")
    return rounded(models.best_model(coarse.unionByName(fine), "average_precision"))


@query
def param_grid(spark, folder):
    t = demo.transactions(spark, folder)
    encoder, _ = encode.fit_encoder(t, ["amount", "merchant_id", "currency", "status"])
    rows = encoder.transform(t).select(
        "features", F.col("fraud").alias("label"), split.time_fold(t, 3).alias("fold")
    )
    rows = models.fit_rows(rows, FIT_ROWS)
    _, found = models.search(rows, models.class_counts(rows), {"max_depth": [2, 4]}, folds=3)
    return found.select("params", F.col("value").between(0, 1).alias("is_share"))


# --- streams ------------------------------------------------------------------------


def _event_stream(spark, folder, files_per_batch=None):
    schema = demo.table(spark, folder, "events").schema
    return streaming.read_stream(spark, folder, schema, "events.parquet", files_per_batch)


@query
def stream_scores(spark, folder):
    t = demo.transactions(spark, folder)
    columns = ["amount", "merchant_id", "currency", "status"]
    encoder, _ = encode.fit_encoder(t, columns)
    rows = encoder.transform(t).select("features", F.col("fraud").alias("label"))
    model = models.train_forest(models.fit_rows(rows, FIT_ROWS), models.class_counts(rows))
    out = fresh_path(spark, "scores")
    stream = demo.transactions_from_events(_event_stream(spark, folder))
    keep = ("transaction_id", F.col("fraud").alias("label"))
    streaming.score_stream(stream, encoder, model, out, fresh_path(spark, "checkpoint"), keep).awaitTermination()
    return _judged(spark.read.parquet(out))


@query
def stream_user_features(spark, folder):
    """The month arrives in four parts, one micro-batch each."""
    t = demo.transactions(spark, folder)
    arrivals, checkpoint = fresh_path(spark, "arrivals"), fresh_path(spark, "checkpoint")
    run = streaming.FeatureStream(spark, fresh_path(spark, "features"))
    for low, high in ((1, 8), (9, 16), (17, 24), (25, 31)):
        t.filter(F.dayofmonth("transaction_date").between(low, high)).write.mode("append").parquet(arrivals)
        run.start(streaming.read_stream(spark, arrivals, t.schema), checkpoint).awaitTermination()
    run.finish()
    return _as_doubles(run.features(), [])


@query
def stream_out_of_order(spark, folder):
    """Rows arrive up to three hours late; every 19th row comes twice and every 23rd has no id."""
    t = demo.transactions(spark, folder)
    t = t.withColumn("transaction_id", F.when(F.col("transaction_id") % 23 != 0, F.col("transaction_id")))
    t = t.unionByName(t.filter("transaction_id % 19 = 0"))
    delay = F.pmod(F.xxhash64("transaction_id", "user_id", "transaction_date"), F.lit(10_000))
    arrival = F.unix_micros("transaction_date") + delay * 1_000_000
    first, last = t.agg(F.min(arrival), F.max(arrival)).first()
    part = F.floor((arrival - first) / F.lit((last - first) // 4 + 1))
    arrivals, checkpoint = fresh_path(spark, "arrivals"), fresh_path(spark, "checkpoint")
    run = streaming.FeatureStream(spark, fresh_path(spark, "features"), TxnConfig(windows=("24h", "7d")), late="3h")
    for n in range(4):
        t.filter(part == n).write.mode("append").parquet(arrivals)
        run.start(streaming.read_stream(spark, arrivals, t.schema), checkpoint).awaitTermination()
    run.finish()
    return _as_doubles(run.features(), [])


@query
def stream_activity(spark, folder):
    out = fresh_path(spark, "activity")
    stream = demo.transactions_from_events(_event_stream(spark, folder))
    streaming.activity_stream(stream, out, fresh_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out)


@query
def stream_alerts(spark, folder):
    """The month arrives in two parts; the stream is stopped in between and goes on from its state."""
    t = demo.transactions(spark, folder)
    arrivals, checkpoint, out = (fresh_path(spark, n) for n in ("arrivals", "checkpoint", "alerts"))
    p = alerts.AlertPolicy(width="6h", max_txns=2, silence="3d", forget="8d")
    for low, high in ((1, 14), (15, 31)):
        t.filter(F.dayofmonth("transaction_date").between(low, high)).write.mode("append").parquet(arrivals)
        alerts.alert_stream(streaming.read_stream(spark, arrivals, t.schema), out, checkpoint, p).awaitTermination()
    return alerts.read_alerts(spark, out).withColumn("at", F.col("at").cast("timestamp_ntz"))
