import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docsift.session import prepare  # noqa: E402

# Started on import, because test modules build columns while they are collected.
SPARK = prepare(
    SparkSession.builder.master("local[8]")
    .appName("docsift-tests")
    .config("spark.ui.enabled", "false")
    .config("spark.driver.memory", "8g")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="docsift-tests-"))
    .getOrCreate()
)
SPARK.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SPARK
    SPARK.stop()


@pytest.fixture
def column(spark):
    """Evaluate a column expression over literal rows of one or more columns."""

    def evaluate(rows, expression, schema="c string"):
        rows = [row if isinstance(row, tuple) else (row,) for row in rows]
        keyed = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], f"n int, {schema}")
        return [row[0] for row in keyed.orderBy("n").select(expression).collect()]

    return evaluate
