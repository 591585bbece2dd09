"""Run named queries next to their SQL twins and report differences.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def session(cpus="8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _order(row):
    return tuple((x is not None, str(type(x)), x if not isinstance(x, (dict, list)) else str(x)) for x in row)


def rows_of(columns, rows):
    """Rows with columns in name order, sorted."""
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    plain = [tuple(_plain(r[n]) for n in order) for r in rows]
    return [columns[n] for n in order], sorted(plain, key=_order)


def spark_rows(df):
    return rows_of(df.columns, df.collect())


def duck_rows(con, sql):
    found = con.execute(sql)
    return rows_of([c[0] for c in found.description], found.fetchall())


def differences(left, right):
    (a_cols, a), (b_cols, b) = left, right
    if a_cols != b_cols:
        return f"columns {a_cols} / {b_cols}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y or [type(v) for v in x] != [type(v) for v in y]]
    if bad:
        return f"{len(bad)} rows differ, first {a_cols}: {bad[0]}"
    return None


def main(argv):
    from __spark_entry__ import oracle_sql, queries

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(queries())
    spark, con = session(), duck(folder)
    oracles, failed = oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            columns, got = found = spark_rows(queries()[name](spark, folder))
            took = time.time() - start
            problem = differences(found, duck_rows(con, oracles[name])) if name in oracles else None
            kind = "ok" if name in oracles else "rows"
        except Exception as e:  # report and go on with the next query
            problem, took, got = f"{type(e).__name__}: {str(e)[:700]}", time.time() - start, []
        failed += problem is not None
        print(f"{'FAIL' if problem else kind:5}{name:32}{len(got):8} rows {took:7.2f} s  {problem or ''}", flush=True)
    print(f"{failed} failed of {len(names)}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
