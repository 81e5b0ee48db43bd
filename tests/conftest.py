import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from siftstone.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


SALES = [
    ("2024-01-01", "North", "Widget A", 1200.50, 10, 0.05),
    ("2024-01-02", "South", "Widget B", 2300.00, 20, 0.10),
    ("2024-01-03", "North", "Widget C", 450.75, 5, 0.00),
    ("2024-01-04", "East", "Widget A", 3100.00, 25, 0.15),
    ("2024-01-05", "West", "Widget B", 800.25, 8, 0.05),
    ("2024-01-06", "South", "Widget C", -50.00, 2, 0.00),
    ("2024-01-07", "North", "Widget A", 5200.00, 40, 0.20),
    ("2024-01-08", "East", "Widget B", 1100.50, 11, 0.10),
    ("2024-01-09", "West", "Widget C", 0.00, 0, 0.00),
    ("2024-01-10", "North", "Widget A", 4300.75, 35, 0.12),
]
SALES_SCHEMA = "date string, region string, product string, revenue double, units long, discount_pct double"


@pytest.fixture(scope="session")
def sales(spark):
    return spark.createDataFrame(SALES, SALES_SCHEMA)
