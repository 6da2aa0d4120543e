import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from measureloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    # Tables here have a handful of rows: compiling code would cost more than running it.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def make(spark):
    return lambda schema, rows: frame(spark, schema, rows)
