import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

AS_OF = "2024-01-31 00:00:00"


@pytest.fixture(scope="session")
def spark():
    from winnow.session import build_session

    session = build_session("8", 4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def one(spark):
    """Evaluate a column expression over one row of literals."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        columns = [F.lit(v).cast("string") if v is None or isinstance(v, str) else F.lit(v) for v in values]
        return spark.range(1).select(fn(*columns).alias("x")).first()["x"]

    return run
