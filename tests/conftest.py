import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cores="4", spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def frame(spark):
    """``frame(columns, *rows)``: a DataFrame from literal rows."""
    return lambda columns, *rows: spark.createDataFrame(list(rows), columns)


@pytest.fixture(scope="session")
def scored(spark):
    """``scored(ys, ps)``: a scored table from two lists."""
    return lambda ys, ps: spark.createDataFrame(
        [(i, y, float(p)) for i, (y, p) in enumerate(zip(ys, ps))], "key long, y int, p double"
    )
