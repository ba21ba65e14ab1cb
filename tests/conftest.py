import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corridor_spark.session import build_session, drop_staged  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="corridor-tests-")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_staged(session)
    session.stop()


def one(spark, build, *values, types=None):
    """Value of a column expression over one row of strings c0, c1 …"""
    from pyspark.sql import functions as F

    schema = ", ".join(f"c{i} {(types or ['string'] * len(values))[i]}" for i in range(len(values)))
    row = spark.createDataFrame([tuple(values)], schema)
    return row.select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("out")).first()["out"]
