import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from broadsheet.session import get_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def values(spark):
    """Apply a column function to a list of texts and collect the results in order; with ``first``, one that takes the name of its result."""

    def run(function, texts, first=None):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").coalesce(1)
        if first:
            df = df.select("i", first(df["x"]).alias("page"))
        column = "page" if first else df["x"]
        return [row["y"] for row in df.select("i", function(column).alias("y")).orderBy("i").collect()]

    return run
