import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from driftpanel.session import configure  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def value_of(spark):
    """Evaluates one column over one row."""

    def evaluate(column, **fields):
        names = list(fields) or ["_"]
        types = {int: "bigint", float: "double", bool: "boolean"}
        schema = ", ".join(f"{n} {types.get(type(fields.get(n)), 'string')}" for n in names)
        row = spark.createDataFrame([tuple(fields.get(n) for n in names)], schema)
        return row.select(column.alias("v")).first()["v"]

    return evaluate
