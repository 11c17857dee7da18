import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__  # noqa: E402,F401  registers the package for Python workers
from matchflow.session import new_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = new_session("local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                          spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over a single text ``x``."""
    def evaluate(column, text):
        return spark.createDataFrame([(text,)], "x string").select(column.alias("v")).first()["v"]
    return evaluate
