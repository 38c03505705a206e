import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from casebase.session import local_session
    s = local_session("*", 8, app="casebase-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def micro(spark):
    """The 8-row micro fixture: training cases and three queries (z is unseen)."""
    train = spark.createDataFrame(
        [(0, "a", "x", 1.0, "P"), (1, "a", "y", 2.0, "P"), (2, "b", "x", 4.0, "N"),
         (3, "b", "y", 3.0, "N"), (4, "c", "x", 2.5, "P"), (5, "c", "y", 6.0, "N"),
         (6, "a", "x", 1.5, "P"), (7, "b", "x", 5.0, "P")],
        "id long, f1 string, f2 string, f3 double, label string")
    queries = spark.createDataFrame(
        [(100, "a", "y", 1.2, "P"), (101, "b", "y", 5.5, "N"), (102, "z", "x", 2.0, "P")],
        "id long, f1 string, f2 string, f3 double, label string")
    return train, queries
