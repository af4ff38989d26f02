import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from firmatlas.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            # Call sites of every column cost a round trip each.
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="firmatlas-warehouse-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def rows(spark):
    """DataFrame from a DDL schema and row tuples."""

    def make(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return make


@pytest.fixture
def one(spark):
    """Value of a column expression over a single text."""
    from pyspark.sql import functions as F

    def evaluate(expression, text):
        df = spark.createDataFrame([(text,)], "c string")
        return df.select(expression(F.col("c")).alias("v")).first()["v"]

    return evaluate
