import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logweft.session import local_session  # noqa: E402

DATA = os.environ.get("LOGWEFT_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def one(spark):
    """Evaluate expressions over one row of literals."""
    from pyspark.sql import functions as F

    def evaluate(expression, **values):
        row = spark.range(1)
        for name, value in values.items():
            column = value if not isinstance(value, (str, int, float, list, type(None))) else None
            if column is None:
                column = F.lit(value) if not isinstance(value, list) else F.array(*[F.lit(x) for x in value])
                if value == []:
                    column = F.array().cast("array<string>")
            row = row.withColumn(name, column)
        return row.select(expression.alias("r")).first()["r"]

    return evaluate
