import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session()
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return SF


TXN_SCHEMA = (
    "transaction_id long, user_id long, merchant_id long, transaction_date string, amount double,"
    " currency string, status string, fraud int"
)


@pytest.fixture(scope="session")
def four_rows(spark):
    return spark.createDataFrame(
        [
            # The rows for which results are known from elsewhere
            (1, 1, 10, "2024-01-01 00:00:00", 100.0, "USD", "approved", 0),
            (2, 1, 10, "2024-01-01 00:30:00", 150.0, "USD", "approved", 1),
            (3, 1, 11, "2024-01-01 02:00:00", 200.0, "USD", "declined", 0),
            (4, 2, 10, "2024-01-01 00:10:00", 50.0, "EUR", "approved", 0),
        ],
        TXN_SCHEMA,
    )


def by_id(df, column, id_="transaction_id"):
    return [r[column] for r in df.orderBy(id_).collect()]
