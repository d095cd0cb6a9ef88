import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tabrig.session import local_session
    s = local_session("*", shuffle_partitions=8, app="tabrig-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def loan(spark):
    """Invented 20-row loan table with the reference sample's shape."""
    rows = [(25 + i, 30000 + 2500 * i, 550 + 12 * i, 1 if (i % 10) not in (0, 3, 7) else 0) for i in range(20)]
    return spark.createDataFrame(rows, "Age long, Income long, Credit_Score long, Loan_Approved long")
