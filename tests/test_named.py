"""Aggregates by name over the windows before each row."""

import statistics

import pytest
from conftest import by_id

from swipewatch import TxnConfig
from swipewatch.operators.named import AGGREGATES, rolling_by_name


def test_known_rows(four_rows):
    cfg = TxnConfig(windows=("3h",))
    out = rolling_by_name(four_rows, AGGREGATES, "user_id", cfg).cache()
    assert out.columns[:8] == four_rows.columns and len(out.columns) == 8 + len(AGGREGATES)
    # the third row of user 1 sees 100 and 150
    want = {"count": 2, "sum": 250.0, "min": 100.0, "max": 150.0, "first": 100.0, "last": 150.0, "mean": 125.0, "median": 125.0, "nunique": 2}
    want |= {"std": statistics.stdev([100, 150]), "var": 1250.0, "p25": 112.5, "p90": 145.0, "skew": None, "kurt": None}
    for agg, value in want.items():
        got = by_id(out, f"amount_{agg}_3h")
        assert got[2] == (value if value is None else pytest.approx(value)) and got[0] is None and got[3] is None, agg


def test_unknown_name(four_rows):
    with pytest.raises(ValueError, match="mode"):
        rolling_by_name(four_rows, ["mode"], "user_id")
