import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pricewell.session import get_spark

    s = get_spark("tests", cpus=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def rows(spark):
    """Evaluate columns over literal rows: rows(["a"], expr) -> list of values."""

    def run(values, expr, name="t"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
        return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]

    return run
