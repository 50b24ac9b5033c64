import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rolemeter.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]",
        spark__driver__memory="8g", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column built from literals."""
    return lambda column: spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="session")
def values(spark):
    """Apply a column function to many inputs at once, in order."""

    def apply(function, inputs, kind):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
        return [r["out"] for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]

    return apply
