import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from agoralytics.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4)


@pytest.fixture
def one(spark):
    """Value of a text expression for one text."""
    from pyspark.sql import functions as F

    def value(expression, text):
        row = spark.createDataFrame([(text,)], "t string").select(
            expression(F.col("t")).alias("v")
        )
        return row.head()["v"]

    return value
