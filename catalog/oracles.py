"""The same queries as SQL for a single-node engine, written independently of the Spark plans."""

from __future__ import annotations

ORACLES = {}

TXN = """txn AS (
  SELECT event_id AS transaction_id, user_id,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS merchant_id,
         ts AS transaction_date, value AS amount,
         CAST(round(value * 100) AS BIGINT) AS cents,
         CASE WHEN event_id % 20 < 12 THEN 'USD' WHEN event_id % 20 < 17 THEN 'EUR' ELSE 'GBP' END AS currency,
         CASE event_type WHEN 'error' THEN 'declined' WHEN 'signup' THEN 'reversed' ELSE 'approved' END AS status,
         CASE WHEN (event_id * 7919) % 100 < 2 + (CASE WHEN value > 115 THEN 8 ELSE 0 END)
              + (CASE event_type WHEN 'error' THEN 5 WHEN 'signup' THEN 8 ELSE 0 END)
              THEN 1 ELSE 0 END AS fraud
  FROM events)"""

GAPS = TXN + """, gaps AS (
  SELECT * REPLACE (CASE WHEN transaction_id % 17 <> 0 THEN amount END AS amount) FROM txn)"""

USERS = """users AS (
  SELECT c_custkey AS user_id, c_name AS user_name, lower(c_name) || '@example.com' AS email,
         CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS TIMESTAMP) AS created_at FROM customer)"""

SECONDS = {"1h": 3600, "24h": 86400, "7d": 604800, "30d": 2592000}


def add(name, body, *ctes):
    ORACLES[name] = (f"WITH {', '.join(ctes)}\n" if ctes else "") + body.strip()


# --- rolling features ---------------------------------------------------------------


def _frame(seconds, until="INTERVAL 1 MICROSECOND"):
    return f"RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND {until} PRECEDING"


def _rolling(key, family, aggs, windows=SECONDS, time="transaction_date"):
    columns, named = [], []
    for label, seconds in windows.items():
        w = f"{family}_{label}_w"
        named.append(f"{w} AS (PARTITION BY {key} ORDER BY {time} {_frame(seconds)})")
        seen = f"count(amount) OVER {w}"
        total = f"CAST(sum(cents) OVER {w} AS DOUBLE)"
        if "count" in aggs:
            columns.append(f"CAST(CASE WHEN count(*) OVER {w} > 0 THEN {seen} END AS DOUBLE) AS {family}_txn_count_{label}")
        if "sum" in aggs:
            columns.append(f"{total} / 100 AS {family}_amount_sum_{label}")
        if "mean" in aggs:
            columns.append(f"{total} / nullif({seen}, 0) / 100 AS {family}_amount_mean_{label}")
        if "fraud" in aggs:
            columns.append(
                f"CAST(sum(fraud) OVER {w} AS DOUBLE) / nullif(count(fraud) OVER {w}, 0)"
                f" AS {family}_fraud_rate_{label}"
            )
    return columns, named


RECENCY = (
    "(epoch_us(transaction_date) - epoch_us(lag(transaction_date) OVER user_order)) / 1e6 AS user_time_since_last_txn"
)
ZSCORE = (
    "CASE WHEN stddev_samp(amount) OVER user_past > 0 THEN"
    " round((amount - avg(amount) OVER user_past) / stddev_samp(amount) OVER user_past, 6) END AS user_amount_zscore"
)
USER_NAMED = [
    "user_order AS (PARTITION BY user_id ORDER BY transaction_date, transaction_id)",
    "user_past AS (PARTITION BY user_id ORDER BY transaction_date, transaction_id"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
]


def _select(columns, named, source="txn"):
    return f"SELECT transaction_id, {', '.join(columns)} FROM {source} WINDOW {', '.join(named)}"


_user = _rolling("user_id", "user", ("count", "sum", "mean"))
_merchant = _rolling("merchant_id", "merchant", ("count", "mean", "fraud"))
_currency = _rolling("currency", "currency", ("count",))
_status = _rolling("status", "status", ("count",))
add("user_rolling", _select(*_user), TXN)
add("user_recency", _select([RECENCY], USER_NAMED), TXN)
add("user_zscore", _select([ZSCORE], USER_NAMED), TXN)
add("merchant_rolling", _select(*_rolling("merchant_id", "merchant", ("count", "mean"))), TXN)
add("merchant_fraud_rate", _select(*_rolling("merchant_id", "merchant", ("fraud",))), TXN)
add("currency_rolling", _select(*_currency), TXN)
add("currency_rolling_split", _select(*_currency), TXN)
add("status_rolling", _select(*_status), TXN)
add(
    "transaction_features",
    _select(
        [RECENCY, ZSCORE, *_user[0], *_merchant[0], *_currency[0], *_status[0]],
        [*USER_NAMED, *_user[1], *_merchant[1], *_currency[1], *_status[1]],
    ),
    TXN,
)
add(
    "merchant_fraud_rate_delayed",
    f"""SELECT transaction_id, CAST(sum(fraud) OVER w AS DOUBLE) / nullif(count(fraud) OVER w, 0)
               AS merchant_fraud_rate_7d
        FROM txn WINDOW w AS (PARTITION BY merchant_id ORDER BY transaction_date
          {_frame(604800, "INTERVAL 86400000001 MICROSECONDS")})""",
    TXN,
)
ORDERS = """txn AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS user_id, o_orderstatus AS status,
         o_orderdate AS transaction_date, o_totalprice AS amount,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""
_tied_user = _rolling("user_id", "user", ("count", "sum", "mean"), {"30d": SECONDS["30d"]})
_tied_status = _rolling("status", "status", ("count",), {"30d": SECONDS["30d"]})
add(
    "rolling_tied_times",
    _select([RECENCY, ZSCORE, *_tied_user[0], *_tied_status[0]], [*USER_NAMED, *_tied_user[1], *_tied_status[1]]),
    ORDERS,
)



def _named_windows(key, order="transaction_date"):
    return [f"w{label} AS (PARTITION BY {key} ORDER BY {order} {_frame(seconds)})" for label, seconds in SECONDS.items()]


def _moving_aggregates(key, source, aggs):
    """Aggregates by name over each window; ``{w}`` stands for the window."""
    columns = [
        f"round({sql.format(w=f'w{label}')} + 3e-8, 6) + 0.0 AS amount_{name}_{label}" for label in SECONDS for name, sql in aggs.items()
    ]
    return _select(columns, _named_windows(key), source)


_EXTREMES = {
    "min": "min(amount) OVER {w}",
    "max": "max(amount) OVER {w}",
    "first": "arg_min(amount, (epoch_us(transaction_date), transaction_id)) FILTER (amount IS NOT NULL) OVER {w}",
    "last": "arg_max(amount, (epoch_us(transaction_date), transaction_id)) FILTER (amount IS NOT NULL) OVER {w}",
}
# without spread skewness and kurtosis are not defined
_SPREAD = "CASE WHEN max(amount) OVER {w} > min(amount) OVER {w} THEN "
_MOMENTS = {
    "mean": "avg(amount) OVER {w}",
    "std": "stddev_samp(amount) OVER {w}",
    "var": "var_samp(amount) OVER {w}",
    "skew": _SPREAD + "skewness(amount) OVER {w} END",
    "kurt": _SPREAD + "kurtosis(amount) OVER {w} END",
}
add("rolling_extremes", _moving_aggregates("user_id", "txn", _EXTREMES), TXN)
add("rolling_extremes_split", _moving_aggregates("currency", "gaps", _EXTREMES), GAPS)
add("rolling_moments", _moving_aggregates("user_id", "gaps", _MOMENTS), GAPS)
add("rolling_moments_split", _moving_aggregates("currency", "txn", _MOMENTS), TXN)

_QUANTILES = {"median": "quantile_cont(amount, 0.5) OVER {w}", "p90": "quantile_cont(amount, 0.9) OVER {w}"}
add("rolling_median", _moving_aggregates("user_id", "gaps", _QUANTILES), GAPS)
add("rolling_median_split", _moving_aggregates("currency", "gaps", _QUANTILES), GAPS)


def _different(key, value="merchant_id"):
    columns = [
        f"CAST(CASE WHEN count(*) OVER w{label} > 0 THEN count(DISTINCT {value}) OVER w{label} END AS DOUBLE) AS merchants_{label}"
        for label in SECONDS
    ]
    return _select(columns, _named_windows(key))


add("rolling_distinct", _different("user_id"), TXN)
add("rolling_distinct_split", _different("currency"), TXN)

_features = _select(
    [RECENCY, ZSCORE, *_user[0], *_merchant[0], *_currency[0], *_status[0]],
    [*USER_NAMED, *_user[1], *_merchant[1], *_currency[1], *_status[1]],
    "counted",
)
add(
    "point_in_time_features",
    f"""SELECT f.* FROM ({_features}) f JOIN gaps USING (transaction_id)
        WHERE transaction_date >= (SELECT max(transaction_date) - INTERVAL 7 DAYS FROM gaps)""",
    GAPS + ", counted AS (SELECT * REPLACE (CASE WHEN amount IS NOT NULL THEN cents END AS cents) FROM gaps)",
)

# --- series -------------------------------------------------------------------------


def _moving(key, n):
    return f"""SELECT transaction_id, round(m, 6) AS moving_average FROM (
      SELECT transaction_id, avg(amount) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m,
             row_number() OVER w AS pos
      FROM txn WINDOW w AS (PARTITION BY {key} ORDER BY transaction_date, transaction_id)) WHERE pos >= {n}"""


def _numbered(key):
    return f"""s AS (SELECT transaction_id, {key} AS k, amount AS x,
      row_number() OVER (PARTITION BY {key} ORDER BY transaction_date, transaction_id) AS pos,
      amount - lag(amount) OVER (PARTITION BY {key} ORDER BY transaction_date, transaction_id) AS d FROM txn)"""


EMA = """e AS (
  SELECT k, pos, transaction_id, x AS y FROM s WHERE pos = 1
  UNION ALL
  SELECT s.k, s.pos, s.transaction_id, 0.3e0 * s.x + 0.7e0 * e.y FROM e JOIN s ON s.k = e.k AND s.pos = e.pos + 1)"""

RSI = """seed AS (
  SELECT k, sum(greatest(d, 0)) / 14 AS g, sum(greatest(-d, 0)) / 14 AS l FROM s WHERE pos BETWEEN 2 AND 14 GROUP BY k),
e AS (
  SELECT s.k, s.pos, s.transaction_id, seed.g, seed.l FROM s JOIN seed ON s.k = seed.k WHERE s.pos = 14
  UNION ALL
  SELECT s.k, s.pos, s.transaction_id, (e.g * 13 + greatest(s.d, 0)) / 14, (e.l * 13 + greatest(-s.d, 0)) / 14
  FROM e JOIN s ON s.k = e.k AND s.pos = e.pos + 1)"""
RSI_VALUE = "round(CASE WHEN l = 0 THEN 100e0 ELSE 100e0 - 100e0 / (1e0 + g / l) END, 6) AS rsi"

add("moving_average", _moving("user_id", 5), TXN)
add("moving_average_split", _moving("currency", 20), TXN)
for _name, _key in (("", "user_id"), ("_split", "currency")):
    _with = (f"RECURSIVE {TXN}", _numbered(_key))
    add(f"ema{_name}", "SELECT transaction_id, round(y, 6) AS ema FROM e", *_with, EMA)
    add(f"rsi{_name}", f"SELECT transaction_id, {RSI_VALUE} FROM e", *_with, RSI)
_with = (f"RECURSIVE {TXN}", _numbered("user_id"))
add("ema_last", "SELECT k AS user_id, round(arg_max(y, pos), 6) AS ema FROM e GROUP BY k", *_with, EMA)
add(
    "rsi_last",
    f"SELECT k AS user_id, {RSI_VALUE} FROM (SELECT k, arg_max(g, pos) AS g, arg_max(l, pos) AS l FROM e GROUP BY k)",
    *_with,
    RSI,
)

# --- cleaning -----------------------------------------------------------------------

add(
    "amount_clean",
    """SELECT transaction_id, round(CASE WHEN amount IS NULL OR abs(amount - mean) / sd > 4 THEN mid ELSE amount END, 6)
              AS amount
       FROM gaps, st, med""",
    GAPS,
    "st AS (SELECT avg(amount) AS mean, stddev_samp(amount) AS sd FROM gaps)",
    "med AS (SELECT median(amount) AS mid FROM gaps, st WHERE abs(amount - mean) <= 4 * sd)",
)
add(
    "amount_stats",
    "SELECT count(amount) AS n, round(avg(amount), 6) AS mean, round(stddev_samp(amount), 6) AS sd FROM gaps",
    GAPS,
)
add("remove_missing", "SELECT transaction_id, amount FROM gaps WHERE amount IS NOT NULL", GAPS)
add(
    "remove_outliers",
    "SELECT transaction_id, amount FROM gaps, st WHERE amount IS NULL OR abs(amount - mean) <= 3 * sd",
    GAPS,
    "st AS (SELECT avg(amount) AS mean, stddev_samp(amount) AS sd FROM gaps)",
)
add(
    "remove_outliers_by_user",
    """SELECT transaction_id, gaps.user_id AS user_id, amount FROM gaps JOIN st ON gaps.user_id = st.user_id
       WHERE amount IS NULL OR sd IS NULL OR sd = 0 OR abs(amount - mean) <= 2 * sd""",
    GAPS,
    "st AS (SELECT user_id, avg(amount) AS mean, stddev_samp(amount) AS sd FROM gaps GROUP BY user_id)",
)
add(
    "binarize_scores",
    "SELECT transaction_id, CASE WHEN amount / 100 > 0.5 THEN 1 ELSE 0 END AS large FROM txn",
    TXN,
)
_RULE = """round(least(greatest(0.02e0 + CASE WHEN amount > {limit} THEN 0.08e0 ELSE 0e0 END
  + CASE status WHEN 'declined' THEN 0.05e0 WHEN 'reversed' THEN 0.08e0 ELSE 0e0 END, 0e0), 0.5e0), 6)"""
add(
    "risk_rule",
    f"SELECT transaction_id, {_RULE.format(limit='p90')} AS score FROM txn, p",
    TXN,
    "p AS (SELECT quantile_cont(amount, 0.9) AS p90 FROM txn)",
)
add("drop_columns", "SELECT transaction_id, round(amount, 6) AS amount, currency, status, fraud FROM txn", TXN)
add(
    "parse_times",
    """SELECT transaction_id, CASE WHEN transaction_id % 13 = 0 THEN -1
              WHEN transaction_id % 7 = 0 THEN CAST(epoch(date_trunc('second', transaction_date)) AS BIGINT) - 7200
              WHEN transaction_id % 5 = 0 THEN CAST(epoch(date_trunc('minute', transaction_date)) AS BIGINT)
              ELSE CAST(epoch(date_trunc('second', transaction_date)) AS BIGINT) END AS seconds FROM txn""",
    TXN,
)
add(
    "label_encode",
    "SELECT transaction_id, status, CAST(dense_rank() OVER (ORDER BY status) - 1 AS INTEGER) AS code FROM txn",
    TXN,
)

# --- sources and retrieval ----------------------------------------------------------

_ALL = "transaction_id, user_id, merchant_id, transaction_date, round(amount, 6) AS amount, currency, status"
add("ingest_csv_scan", f"SELECT {_ALL}, fraud FROM gaps", GAPS)
add("ingest_run", f"SELECT {_ALL}, fraud, strftime(transaction_date, '%Y-%m-%d') AS day FROM txn", TXN)
add(
    "ingest_table_modes",
    "SELECT currency, 2 * count(*) AS rows, count(DISTINCT transaction_id) AS ids FROM txn GROUP BY currency",
    TXN,
)
add("ingest_snapshot", f"SELECT {_ALL}, fraud FROM txn", TXN)
add(
    "txn_date_range",
    f"""SELECT {_ALL}, fraud FROM txn
        WHERE transaction_date BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'""",
    TXN,
)
add("users_projection", "SELECT * FROM users", USERS)
add("fraud_txns", f"SELECT {_ALL} FROM txn WHERE fraud = 1", TXN)
add("txns_by_user", f"SELECT {_ALL}, fraud FROM txn WHERE user_id = 7", TXN)
add("user_lookup", "SELECT * FROM users WHERE user_id = 11 OR email = 'customer#000000005@example.com'", USERS)

# --- joins and keys -----------------------------------------------------------------

add(
    "txn_user_enrich",
    """SELECT transaction_id, txn.user_id AS user_id, user_name, email
       FROM txn LEFT JOIN users ON txn.user_id = users.user_id""",
    TXN,
    USERS,
)
add(
    "orphan_txns",
    """SELECT transaction_id, user_id FROM txn
       WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = txn.user_id AND c_acctbal >= 0)""",
    TXN,
)
add(
    "pk_violations",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
add(
    "dedupe_append",
    """SELECT transaction_id, status, round(amount + CASE WHEN transaction_date >= TIMESTAMP '2024-01-16'
              THEN 1000e0 ELSE 0e0 END, 6) AS amount FROM txn""",
    TXN,
)

add(
    "merge_versions",
    """SELECT transaction_id, transaction_date, amount FROM txn WHERE transaction_id % 7 <> 0 OR transaction_id % 5 = 0
       UNION ALL
       SELECT transaction_id, transaction_date + INTERVAL 3 HOURS, round(amount + 3000e0, 6) FROM txn
       WHERE transaction_id % 7 = 0 AND transaction_id % 5 <> 0
       UNION ALL
       SELECT NULL, transaction_date + to_hours(s), round(amount + 1000e0 * s, 6) FROM txn, range(1, 4) r(s)
       WHERE transaction_id % 35 = 0""",
    TXN,
)

# --- totals and profiles ------------------------------------------------------------

_MONEY = "count(*) AS txns, round(CAST(sum(cents) AS DOUBLE) / 100, 6) AS amount"
add("user_totals", f"SELECT user_id, {_MONEY} FROM txn GROUP BY user_id", TXN)
add(
    "daily_totals",
    f"SELECT CAST(date_trunc('day', transaction_date) AS TIMESTAMP) AS period, {_MONEY} FROM txn GROUP BY 1",
    TXN,
)
add(
    "user_day_rollup",
    f"""SELECT coalesce(user_id, -1) AS user_id, strftime(day, '%Y-%m-%d') AS day, {_MONEY},
               CAST(grouping(user_id) * 2 + grouping(day) AS INTEGER) AS level
        FROM (SELECT *, CAST(transaction_date AS DATE) AS day FROM txn) GROUP BY ROLLUP (user_id, day)""",
    TXN,
)
add(
    "class_weights",
    """SELECT positives, negatives, classes,
              CASE WHEN positives = 0 OR negatives = 0 THEN 1e0
                   ELSE round(CAST(negatives AS DOUBLE) / positives, 6) END AS scale_pos_weight
       FROM (SELECT count(*) FILTER (fraud = 1) AS positives, count(*) FILTER (fraud = 0) AS negatives,
                    count(DISTINCT fraud) AS classes FROM txn)""",
    TXN,
)
_NAMED = "f AS (SELECT user_id, 'cents' AS name, CAST(cents AS DOUBLE) AS x FROM txn UNION ALL SELECT user_id, 'is_' || status, 1e0 FROM txn)"
add(
    "aggregate_features",
    """SELECT f.user_id AS user_id, name, sum(x) / any_value(n) AS average
       FROM f JOIN (SELECT user_id, count(*) AS n FROM txn GROUP BY user_id) c ON f.user_id = c.user_id
       GROUP BY f.user_id, name""",
    TXN,
    _NAMED,
)
add(
    "aggregate_features_all",
    "SELECT name, sum(x) / (SELECT count(*) FROM txn) AS average FROM f GROUP BY name",
    TXN,
    _NAMED,
)
add(
    "aggregate_features_null_key",
    """SELECT p.part AS part, 'in_' || currency AS name, round(count(*) / any_value(n), 6) AS average
       FROM (SELECT CASE WHEN user_id % 3 <> 0 THEN user_id % 5 END AS part, currency FROM txn) p
       JOIN (SELECT CASE WHEN user_id % 3 <> 0 THEN user_id % 5 END AS part, count(*) AS n FROM txn GROUP BY 1) c
         ON p.part IS NOT DISTINCT FROM c.part
       GROUP BY ALL""",
    TXN,
)
_COLUMNS = ("transaction_id", "user_id", "merchant_id", "transaction_date", "amount", "currency", "status", "fraud")
add(
    "profile_nulls",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing FROM gaps" for c in _COLUMNS
    ),
    GAPS,
)
add(
    "schema_roles",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{'categorical' if c in ('transaction_date', 'currency', 'status') else 'numeric'}'"
        f" AS role, count(*) - count({c}) AS missing FROM gaps"
        for c in _COLUMNS
    ),
    GAPS,
)


def _describe(c):
    q = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75))
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean,"
        f" round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, {q},"
        f" CAST(max({c}) AS DOUBLE) AS max FROM (SELECT * REPLACE (CAST({c} AS DOUBLE) AS {c}) FROM gaps)"
    )


for _name in ("describe_amount", "describe_amount_split"):
    add(_name, "\nUNION ALL ".join(_describe(c) for c in ("amount", "merchant_id", "fraud")), GAPS)
_NUMBERS = ("amount", "merchant_id", "fraud")
add(
    "corr_matrix",
    "\nUNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS corr FROM txn" for a in _NUMBERS for b in _NUMBERS
    ),
    TXN,
)
add(
    "histogram_amount",
    """SELECT CAST(b AS INTEGER) AS bin, round(lo + b * (hi - lo) / 20, 6) AS bin_start, count(amount) AS n
       FROM range(20) r(b) CROSS JOIN (SELECT min(amount) AS lo, max(amount) AS hi FROM gaps) e
       LEFT JOIN gaps ON least(floor((amount - lo) / ((hi - lo) / 20)), 19) = b GROUP BY b, lo, hi""",
    GAPS,
)
add(
    "histogram_amount_bounds",
    """SELECT CAST(b AS INTEGER) AS bin, CASE WHEN b >= 0 THEN 50e0 + b * 10e0 END AS bin_start, count(amount) AS n
       FROM range(-1, 11) r(b) LEFT JOIN txn
         ON b = CASE WHEN amount < 50 THEN -1 WHEN amount > 150 THEN 10 ELSE least(floor((amount - 50) / 10), 9) END
       GROUP BY b""",
    TXN,
)
_PROBS = "(0e0), (0.3e0), (0.599e0), (0.61e0), (0.65e0), (0.699e0), (0.7e0), (0.9e0), (1e0)"
_RANKED = """(SELECT *, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () - 1 AS m FROM (SELECT * FROM v))"""
add(
    "quantiles_inflated",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", p, round(max({c}) FILTER (r = floor(p * m)) + (max({c}) FILTER (r = ceil(p * m))
            - max({c}) FILTER (r = floor(p * m))) * (p * any_value(m) - floor(p * any_value(m))), 6) AS value
            FROM {_RANKED.format(c=c)}, (VALUES {_PROBS}) q(p) GROUP BY p"""
        for c in ("x", "amount")
    ),
    TXN,
    """v AS (SELECT amount, CASE WHEN transaction_id % 10 < 6 THEN 0e0 WHEN transaction_id % 10 < 9 THEN 1e0
                 ELSE amount / 1000 END AS x FROM txn)""",
)


def _box(c):
    return f"""SELECT '{c}' AS "column", round(any_value(q1), 6) AS q25, round(any_value(q2), 6) AS q50,
      round(any_value(q3), 6) AS q75,
      CAST(min(CASE WHEN {c} >= q1 - 1.5e0 * (q3 - q1) THEN {c} END) AS DOUBLE) AS whisker_low,
      CAST(max(CASE WHEN {c} <= q3 + 1.5e0 * (q3 - q1) THEN {c} END) AS DOUBLE) AS whisker_high,
      count(*) FILTER ({c} NOT BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)) AS outliers
      FROM gaps, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2,
                         quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM gaps)"""


add("boxplot_stats", "\nUNION ALL ".join(_box(c) for c in ("amount", "merchant_id")), GAPS)
add(
    "by_label_summary",
    "\nUNION ALL ".join(
        f"""SELECT fraud, '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
            round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max
            FROM txn GROUP BY fraud"""
        for c in ("amount", "merchant_id")
    ),
    TXN,
)

# --- order and splits ---------------------------------------------------------------

add("sorted_txns", "SELECT transaction_id, transaction_date FROM txn ORDER BY transaction_date, transaction_id", TXN)
_CUT = """cut AS (SELECT *, row_number() OVER (ORDER BY transaction_date, transaction_id)
  <= greatest(1, CAST(floor((SELECT count(*) FROM txn) * (1 - {size}e0)) AS BIGINT)) AS is_train FROM txn)"""
add("time_split", "SELECT transaction_id, is_train FROM cut", TXN, _CUT.format(size=0.2))
add(
    "time_split_refined",
    "SELECT transaction_id, transaction_date, is_train FROM cut",
    ORDERS,
    _CUT.format(size=0.3),
)
add(
    "time_split_repeated",
    """SELECT 'time' AS kind, is_train, CASE WHEN is_train THEN k ELSE n - k END AS rows
       FROM (SELECT count(*) AS n, greatest(1, CAST(floor(count(*) * (1 - 0.25e0)) AS BIGINT)) AS k FROM lineitem),
            (VALUES (true), (false)) t(is_train)
       UNION ALL
       SELECT 'random', is_train, CASE WHEN is_train THEN n - k ELSE k END
       FROM (SELECT count(*) AS n, CAST(ceil(count(*) * 0.2e0) AS BIGINT) AS k FROM lineitem),
            (VALUES (true), (false)) t(is_train)""",
)
add(
    "time_split_summary",
    """SELECT is_train, count(*) AS rows, CAST(sum(fraud) AS BIGINT) AS frauds,
              min(transaction_date) AS first, max(transaction_date) AS last FROM cut GROUP BY is_train""",
    TXN,
    _CUT.format(size=0.2),
)
_HASH = "CAST('0x' || substr(md5(CAST(transaction_id AS VARCHAR) || ':42'), 1, 13) AS BIGINT)"
add(
    "random_split",
    f"""SELECT transaction_id, row_number() OVER (ORDER BY {_HASH}, transaction_id)
               > ceil((SELECT count(*) FROM txn) * 0.2e0) AS is_train FROM txn""",
    TXN,
)
add(
    "stratified_split",
    f"""SELECT transaction_id, txn.fraud AS fraud,
               row_number() OVER (PARTITION BY txn.fraud ORDER BY {_HASH}, transaction_id) > k AS is_train
        FROM txn JOIN quota ON quota.fraud = txn.fraud""",
    TXN,
    """share AS (SELECT fraud, count(*) * ceil((SELECT count(*) FROM txn) * 0.2e0)
                 / (SELECT count(*) FROM txn) AS exact FROM txn GROUP BY fraud)""",
    """quota AS (SELECT fraud, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, fraud)
                 <= ceil((SELECT count(*) FROM txn) * 0.2e0) - (SELECT sum(floor(exact)) FROM share)
                 THEN 1 ELSE 0 END AS k FROM share)""",
)

# --- metrics ------------------------------------------------------------------------

SCORED = TXN + f""", scored AS (
  SELECT *, CASE WHEN score > 0.09 THEN 1 ELSE 0 END AS prediction FROM (
    SELECT transaction_id, transaction_date, fraud AS label, {_RULE.format(limit='115.0')} AS score FROM txn))"""
FINE = TXN + """, scored AS (
  SELECT fraud AS label, amount AS score, CASE WHEN amount > 115 THEN 1 ELSE 0 END AS prediction FROM txn)"""
DOCS = """scored AS (
  SELECT toxic AS label, CAST(n_chars AS DOUBLE) AS score, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS prediction
  FROM labels JOIN documents USING (doc_id))"""
CELLS = """cells AS (SELECT count(*) AS n, count_if(label = prediction) AS hit,
  count_if(label = 1 AND prediction = 1) AS tp, count_if(label = 0 AND prediction = 1) AS fp,
  count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 0 AND prediction = 0) AS tn FROM scored)"""
STEPS = """steps AS (SELECT score, CAST(count_if(label = 1) AS BIGINT) AS pos, CAST(count_if(label = 0) AS BIGINT) AS neg
  FROM scored GROUP BY score)""" + """, runs AS (SELECT *,
  CAST(sum(pos) OVER (ORDER BY score DESC) AS DOUBLE) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS DOUBLE) AS fp,
  CAST(sum(pos) OVER () AS DOUBLE) AS p, CAST(sum(neg) OVER () AS DOUBLE) AS n FROM steps)"""
AUC = "(SELECT sum(neg * (tp - pos / 2e0)) / any_value(p * n) FROM runs)"
AP = "(SELECT sum(pos / p * tp / (tp + fp)) FROM runs)"
REPORT = f"""
  SELECT 'Accuracy' AS "Metric", round(hit / n, 6) AS "Value" FROM cells
  UNION ALL SELECT 'Precision', round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) FROM cells
  UNION ALL SELECT 'Recall', round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) FROM cells
  UNION ALL SELECT 'F1 Score', round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) FROM cells
  UNION ALL SELECT 'ROC AUC', round({AUC}, 6)
  UNION ALL SELECT 'Average Precision', round({AP}, 6)"""
add("eval_report", REPORT, SCORED, CELLS, STEPS)
add("eval_report_documents", REPORT, DOCS, CELLS, STEPS)
add("roc_auc", f"SELECT round({AUC}, 6) AS roc_auc", FINE, STEPS)
add("average_precision", f"SELECT round({AP}, 6) AS average_precision", FINE, STEPS)
add("ranking_split", f"SELECT round({AUC}, 6) AS roc_auc, round({AP}, 6) AS average_precision", FINE, STEPS)
add(
    "roc_curve",
    """SELECT round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr, round(score, 6) AS threshold FROM runs
       UNION ALL SELECT 0e0, 0e0, NULL""",
    SCORED,
    STEPS,
)
add(
    "roc_corners",
    """SELECT round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr, round(score, 6) AS threshold
       FROM (SELECT *, lag(fp) OVER o AS bf, lag(tp) OVER o AS bt, lead(fp) OVER o AS af, lead(tp) OVER o AS nt
             FROM runs WINDOW o AS (ORDER BY score DESC))
       WHERE bf IS NULL OR af IS NULL OR af - 2 * fp + bf <> 0 OR nt - 2 * tp + bt <> 0
       UNION ALL SELECT 0e0, 0e0, NULL""",
    FINE,
    STEPS,
)
add(
    "sample_by_label",
    f"""SELECT transaction_id, fraud, round(amount, 6) AS amount, currency FROM txn
        QUALIFY row_number() OVER (PARTITION BY fraud ORDER BY {_HASH}, transaction_id) <= 40""",
    TXN,
)
_GRID = "g AS (SELECT a, b FROM range(2) x(a), range(2) y(b))"
add(
    "confusion_matrix",
    """SELECT CAST(a AS INTEGER) AS label, CAST(b AS INTEGER) AS prediction, count(label) AS n
       FROM g LEFT JOIN scored ON label = a AND prediction = b GROUP BY a, b""",
    SCORED,
    _GRID,
)
_KINDS = """kinds AS (SELECT CASE WHEN transaction_id % 11 <> 0 THEN merchant_id % 3 END AS label,
  CASE WHEN transaction_id % 13 <> 0 THEN transaction_id % 4 END AS prediction FROM txn)"""
_OF_KINDS = """(SELECT l.c AS label, p.c AS prediction, count(k.one) AS n
  FROM (SELECT NULL AS c UNION ALL SELECT * FROM range(4)) l CROSS JOIN (SELECT NULL AS c UNION ALL SELECT * FROM range(4)) p
  LEFT JOIN (SELECT *, 1 AS one FROM kinds) k
    ON k.label IS NOT DISTINCT FROM l.c AND k.prediction IS NOT DISTINCT FROM p.c GROUP BY l.c, p.c)"""
add("confusion_matrix_classes", f"SELECT label, prediction, n FROM {_OF_KINDS}", TXN, _KINDS)
add(
    "confusion_matrix_classes_norm",
    f"""SELECT label, prediction, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY label), 0), 0), 6) AS share
        FROM {_OF_KINDS}""",
    TXN,
    _KINDS,
)
add(
    "confusion_matrix_norm",
    """SELECT CAST(a AS INTEGER) AS label, CAST(b AS INTEGER) AS prediction,
              round(CASE WHEN sum(c) OVER (PARTITION BY a) = 0 THEN 0 ELSE c / sum(c) OVER (PARTITION BY a) END, 6) AS share
       FROM (SELECT a, b, count(label) AS c FROM g LEFT JOIN scored ON label = a AND prediction = b GROUP BY a, b)""",
    SCORED,
    _GRID,
)

# --- monitoring ---------------------------------------------------------------------

ACTIVITY = """act AS (SELECT CAST(date_trunc('hour', transaction_date) AS TIMESTAMP) AS window_start, count(*) AS txns,
  CAST(sum(fraud) AS DOUBLE) / count(*) AS fraud_rate,
  CAST(sum(cents) AS DOUBLE) / count(amount) / 100 AS mean_amount FROM txn GROUP BY 1)"""
add("monitor_windows", "SELECT * FROM act", TXN, ACTIVITY)
add("monitor_alerts", "SELECT * FROM act WHERE fraud_rate > 0.15", TXN, ACTIVITY)


def _psi(c):
    cuts = [f"(SELECT quantile_cont(CAST({c} AS DOUBLE), {j / 10}) FROM txn WHERE transaction_date < DATE '2024-01-16')"
            for j in range(1, 10)]
    bin_ = " + ".join(f"CASE WHEN {c} > {cut} THEN 1 ELSE 0 END" for cut in cuts)
    return f"""SELECT '{c}' AS feature, round(sum((q - p) * ln(q / p)), 6) AS psi FROM (
      SELECT greatest(base / sum(base) OVER (), 1e-4) AS p, greatest(now / sum(now) OVER (), 1e-4) AS q FROM (
        SELECT bin, CAST(count_if(transaction_date < DATE '2024-01-16') AS DOUBLE) AS base,
               CAST(count_if(transaction_date >= DATE '2024-01-16') AS DOUBLE) AS now
        FROM (SELECT transaction_date, {bin_} AS bin FROM txn) GROUP BY bin))"""


add(
    "drift_any_periods",
    """SELECT feature, count_if(transaction_date < DATE '2024-01-16') AS n_base,
              count_if(transaction_date >= DATE '2024-01-16') AS n_now, true AS is_close
       FROM (SELECT transaction_date, unnest(['amount', 'merchant_id', 'user_id']) AS feature,
                    unnest([amount, CAST(merchant_id AS DOUBLE), CAST(user_id AS DOUBLE)]) AS x FROM txn)
       WHERE x IS NOT NULL GROUP BY feature""",
    TXN,
)
add("psi_drift", "\nUNION ALL ".join(_psi(c) for c in ("amount", "merchant_id", "user_id")), TXN)
_DAILY = (
    """SELECT c.day AS day, round(hit / n, 6) AS accuracy,
         round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
         round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
         round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1_score,
         round(CASE WHEN pp > 0 AND nn > 0 THEN auc / (pp * nn) END, 6) AS roc_auc,
         round(CASE WHEN pp > 0 THEN ap / pp END, 6) AS average_precision
       FROM c JOIN r ON c.day = r.day""",
    SCORED,
    """c AS (SELECT strftime(transaction_date, '%Y-%m-%d') AS day, count(*) AS n, count_if(label = prediction) AS hit,
       count_if(label = 1 AND prediction = 1) AS tp, count_if(label = 0 AND prediction = 1) AS fp,
       count_if(label = 1 AND prediction = 0) AS fn FROM scored GROUP BY 1)""",
    """st AS (SELECT strftime(transaction_date, '%Y-%m-%d') AS day, score, count_if(label = 1) AS pos,
       count_if(label = 0) AS neg FROM scored GROUP BY 1, 2)""",
    """rn AS (SELECT *, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp FROM st
       WINDOW w AS (PARTITION BY day ORDER BY score DESC))""",
    """r AS (SELECT day, CAST(sum(pos) AS DOUBLE) AS pp, CAST(sum(neg) AS DOUBLE) AS nn,
       sum(neg * (tp - pos / 2e0)) AS auc, sum(pos * tp / (tp + fp)) AS ap FROM rn GROUP BY day)""",
)
add("daily_metrics", *_DAILY)
# only labels of the first seven days count
add(
    "stream_performance",
    _DAILY[0],
    SCORED.replace("FROM txn", "FROM txn WHERE transaction_id % 216 <= 168"),
    *_DAILY[2:],
)

# --- encoding -----------------------------------------------------------------------

PART = GAPS + """, part AS (SELECT transaction_id, CAST(amount AS DOUBLE) AS amount, CAST(merchant_id AS DOUBLE) AS merchant_id,
  CASE WHEN transaction_id % 11 <> 0 THEN currency END AS currency, status FROM gaps)"""
FILLED = """filled AS (SELECT transaction_id, coalesce(amount, (SELECT median(amount) FROM part)) AS a, merchant_id AS m,
  CASE WHEN amount IS NULL THEN 1e0 ELSE 0e0 END AS f FROM part)"""
add(
    "impute_median",
    """SELECT transaction_id, round(a, 6) AS num__amount, round(m, 6) AS num__merchant_id,
              f AS num__missingindicator_amount FROM filled""",
    PART,
    FILLED,
)
add(
    "scale_numeric",
    """SELECT transaction_id, round(a / (SELECT stddev_pop(a) FROM filled), 6) AS num__amount,
              round(m / (SELECT stddev_pop(m) FROM filled), 6) AS num__merchant_id,
              round(f / (SELECT stddev_pop(f) FROM filled), 6) AS num__missingindicator_amount FROM filled""",
    PART,
    FILLED,
)
_MODE = "(SELECT currency FROM {} WHERE currency IS NOT NULL GROUP BY currency ORDER BY count(*) DESC, currency LIMIT 1)"
add(
    "impute_mode",
    f"SELECT transaction_id, coalesce(currency, {_MODE.format('part')}) AS currency FROM part",
    PART,
)
_HOT = [f"CASE WHEN c = '{v}' THEN 1e0 ELSE 0e0 END AS cat__currency_{v.lower()}" for v in ("EUR", "GBP", "USD")]
_HOT += [f"CASE WHEN status = '{v}' THEN 1e0 ELSE 0e0 END AS cat__status_{v}" for v in ("approved", "reversed")]
add(
    "one_hot",
    f"SELECT transaction_id, {', '.join(_HOT)} FROM (SELECT *, coalesce(currency, {_MODE.format('seen')}) AS c FROM part)",
    PART,
    "seen AS (SELECT * FROM part WHERE status <> 'declined')",
)

# --- model choice -------------------------------------------------------------------

add(
    "best_model",
    """SELECT arg_min(model, (-value, model)) AS model, 'average_precision' AS metric, round(max(value), 6) AS value
       FROM (SELECT m AS model, sum(pos / p * tp / (tp + fp)) AS value FROM (
         SELECT *, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp,
                CAST(sum(pos) OVER (PARTITION BY m) AS DOUBLE) AS p
         FROM (SELECT m, score, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM (
           SELECT 'rule' AS m, label, score FROM scored UNION ALL SELECT 'amount', fraud, amount FROM txn) GROUP BY m, score)
         WINDOW w AS (PARTITION BY m ORDER BY score DESC)) GROUP BY m)""",
    SCORED,
)

# --- streams ------------------------------------------------------------------------

# all rows arrive in time: the stream must give what the batch job gives
add(
    "stream_user_features",
    _select([RECENCY, ZSCORE, *_user[0], *_merchant[0]], [*USER_NAMED, *_user[1], *_merchant[1]]),
    TXN,
)
_two = {"24h": SECONDS["24h"], "7d": SECONDS["7d"]}
_late_user = _rolling("user_id", "user", ("count", "sum", "mean"), _two)
_late_merchant = _rolling("merchant_id", "merchant", ("count", "mean", "fraud"), _two)
add(
    "stream_out_of_order",
    _select(
        [RECENCY, ZSCORE, *_late_user[0], *_late_merchant[0]], [*USER_NAMED, *_late_user[1], *_late_merchant[1]], "twice"
    ),
    TXN,
    """loose AS (SELECT * REPLACE (CASE WHEN transaction_id % 23 <> 0 THEN transaction_id END AS transaction_id) FROM txn)""",
    "twice AS (SELECT * FROM loose UNION ALL SELECT * FROM loose WHERE transaction_id % 19 = 0)",
)
# a window is written once the newest time minus one hour has passed its end
add(
    "stream_activity",
    "SELECT * FROM act WHERE window_start + INTERVAL 2 HOURS <= (SELECT max(transaction_date) FROM txn)",
    TXN,
    ACTIVITY,
)
add(
    "stream_alerts",
    """SELECT user_id, 'busy' AS kind, make_timestamp(w * 21600000000) AS at, count(*) AS value FROM closed
       GROUP BY user_id, w HAVING count(*) > 2
       UNION ALL
       SELECT user_id, 'silent', make_timestamp(t), NULL FROM gaps
       WHERE later - t > 259200000000
          OR later IS NULL AND ((t + 259200000000) // 21600000000 + 1) * 21600000000 <= mark
       UNION ALL
       SELECT user_id, 'returned', make_timestamp(later), (later - t) // 1000000 FROM gaps
       WHERE later - t > 259200000000 AND later - t <= 691200000000""",
    TXN,
    """timed AS (SELECT user_id, epoch_us(transaction_date) AS t FROM txn
                 WHERE user_id IS NOT NULL AND transaction_date IS NOT NULL),
       passed AS (SELECT (max(t) // 1000 - 3600000) * 1000 AS mark FROM timed),
       closed AS (SELECT user_id, t, t // 21600000000 AS w, mark FROM timed, passed
                  WHERE (t // 21600000000 + 1) * 21600000000 <= mark),
       gaps AS (SELECT user_id, t, mark, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS later FROM closed)""",
)

# --- preprocessing ------------------------------------------------------------------

CLEAN = """st AS (SELECT avg(amount) AS mean, stddev_samp(amount) AS sd FROM gaps),
med AS (SELECT median(amount) AS mid FROM gaps, st WHERE abs(amount - mean) <= 4 * sd),
clean AS (SELECT transaction_id, fraud,
  CASE WHEN amount IS NULL OR abs(amount - mean) / sd > 4 THEN mid ELSE amount END AS a,
  row_number() OVER (ORDER BY transaction_date, transaction_id)
    <= greatest(1, CAST(floor((SELECT count(*) FROM txn) * (1 - 0.2e0)) AS BIGINT)) AS is_train FROM gaps, st, med)"""
# every feature on the rows with gaps, unrounded
FEATURES = GAPS + """, holes AS (
  SELECT * REPLACE (CASE WHEN transaction_id % 17 <> 0 THEN amount END AS amount,
                    CASE WHEN transaction_id % 17 <> 0 THEN cents END AS cents) FROM txn), feats AS (
""" + _select(
    [
        "currency, status", RECENCY,
        "CASE WHEN stddev_samp(amount) OVER user_past > 0 THEN (amount - avg(amount) OVER user_past)"
        " / stddev_samp(amount) OVER user_past END AS user_amount_zscore",
        *_user[0], *_merchant[0], *_currency[0], *_status[0],
    ],
    [*USER_NAMED, *_user[1], *_merchant[1], *_currency[1], *_status[1]],
    "holes",
) + ")"
NAMES = ["user_time_since_last_txn", "user_amount_zscore"] + [
    f"{family}_{x}_{w}"
    for family, kinds in (
        ("user", ("txn_count", "amount_sum", "amount_mean")),
        ("merchant", ("txn_count", "amount_mean", "fraud_rate")),
        ("currency", ("txn_count",)),
        ("status", ("txn_count",)),
    )
    for x in kinds
    for w in SECONDS
]
HOT = [("currency", c) for c in ("EUR", "GBP", "USD")] + [("status", c) for c in ("approved", "declined", "reversed")]
add(
    "preprocess_features",
    f"""SELECT transaction_id, CASE WHEN is_train THEN 'train' ELSE 'test' END AS part, fraud AS label,
          round(a / (SELECT stddev_pop(a) FROM clean WHERE is_train), 5) AS num__amount,
          {", ".join(f"round(coalesce({n}, m_{n}) / coalesce(nullif(s_{n}, 0), 1), 5) AS num__{n}" for n in NAMES)},
          {", ".join(f"round(CASE WHEN {n} IS NULL THEN 1 / sqrt(g_{n} * (1 - g_{n})) ELSE 0 END, 5) AS num__missingindicator_{n}" for n in NAMES)},
          {", ".join(f"CASE WHEN {c} = '{v}' THEN 1e0 ELSE 0e0 END AS cat__{c}_{v.lower()}" for c, v in HOT)}
        FROM joined, med_of, sd_of""",
    FEATURES,
    CLEAN,
    "joined AS (SELECT feats.*, fraud, a, is_train FROM feats JOIN clean USING (transaction_id))",
    f"med_of AS (SELECT {', '.join(f'median({n}) AS m_{n}' for n in NAMES)} FROM joined WHERE is_train)",
    f"""sd_of AS (SELECT {', '.join(f'stddev_pop(coalesce({n}, m_{n})) AS s_{n}, 1 - count({n}) / count(*) AS g_{n}' for n in NAMES)}
        FROM joined, med_of WHERE is_train)""",
)
WIDTH = 1 + 2 * len(NAMES) + len(HOT)
add(
    "feature_dataset",
    f"""SELECT transaction_id, fraud AS label, {WIDTH} AS width,
               round(a / (SELECT stddev_pop(a) FROM clean WHERE is_train), 6) AS amount FROM clean WHERE is_train""",
    GAPS,
    CLEAN,
)
add(
    "preprocess_metadata",
    f"""SELECT * FROM (VALUES
          ('amount_rule', '4.0'), ('clean_scope', 'all'), ('drop_columns', '[]'), ('feature_names', '{WIDTH}'),
          ('id_columns', '[''transaction_id'', ''user_id'', ''merchant_id'']'), ('label_classes', 'None'),
          ('roles', 'amount,currency,fail,fraud,merchant_id,status,transaction_date,transaction_id,user_id'),
          ('seed', '42'), ('test_size', '0.2'), ('time_based_split', 'True'),
          ('windows', '[''1h'', ''24h'', ''7d'', ''30d'']')) v(setting, value)""",
)

_WIDE = [("name", "'t' || CAST(transaction_id AS VARCHAR)"), ("currency", "currency"), ("merchant", "CAST(merchant_id AS VARCHAR)")]
_OFFSETS = ["0"]
for _, _value in _WIDE:
    _OFFSETS.append(f"{_OFFSETS[-1]} + (SELECT count(DISTINCT {_value}) FROM txn)")
_NUMBERS = ", ".join(
    f"CASE WHEN {v} IS NOT NULL THEN dense_rank() OVER (ORDER BY {v} NULLS LAST) - 1 + {o} END" for (_, v), o in zip(_WIDE, _OFFSETS)
)
add(
    "wide_one_hot",
    f"""SELECT transaction_id, array_to_string(list_filter([{_NUMBERS}], lambda x: x IS NOT NULL), ',') AS slots,
               CAST({_OFFSETS[-1]} AS INTEGER) AS width FROM txn""",
    TXN,
)

# --- models -------------------------------------------------------------------------

# scores themselves are a model's; whose they are, that they are chances, and what follows from them is determined
_TEST = """SELECT transaction_id, fraud AS label, true AS is_chance, true AS follows, true AS learned
           FROM clean WHERE NOT is_train"""
for _name in ("rf_scores", "gbt_scores", "hist_boosting_scores", "balanced_forest_scores"):
    add(_name, _TEST, GAPS, CLEAN)
add(
    "stream_scores",
    "SELECT transaction_id, fraud AS label, true AS is_chance, true AS follows FROM txn",
    TXN,
)
_SLOTS = ["num__amount", *(f"num__{n}" for n in NAMES), *(f"num__missingindicator_{n}" for n in NAMES)]
_SLOTS += [f"cat__{c}_{v.lower()}" for c, v in HOT]
add(
    "feature_importance",
    f"""SELECT feature, true AS is_share, 1e0 AS total FROM (VALUES {", ".join(f"('{n}')" for n in _SLOTS)}) v(feature)""",
)
add("model_roundtrip", "SELECT count(*) AS rows, 0e0 AS difference FROM clean WHERE NOT is_train", GAPS, CLEAN)
add(
    "training_metrics",
    """SELECT model, metric, true AS is_share, true AS agrees
       FROM (VALUES ('random_forest'), ('boosted_trees')) m(model),
            (VALUES ('accuracy'), ('precision'), ('recall'), ('f1_score'), ('roc_auc'), ('average_precision')) n(metric)""",
)
add("param_grid", "SELECT 'maxDepth=' || d AS params, true AS is_share FROM (VALUES (2), (4)) v(d)")
add(
    "train_text_label",
    "SELECT transaction_id, CASE WHEN fraud = 1 THEN 'yes' ELSE 'no' END AS label FROM clean WHERE NOT is_train",
    GAPS,
    CLEAN,
)
add(
    "score_new_table",
    "SELECT transaction_id + 1000000 AS transaction_id, true AS is_chance, true AS learned FROM txn",
    TXN,
)
