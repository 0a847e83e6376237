import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventmill.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


@pytest.fixture
def lines(spark):
    """Frame of numbered text lines."""
    return lambda *values: spark.createDataFrame(list(enumerate(values)), "id bigint, value string")


@pytest.fixture
def records(lines):
    """Frame of numbered records, from JSON lines."""
    from eventmill.operators.parse import parse_events

    return lambda *values: parse_events(lines(*values))


@pytest.fixture
def texts():
    """Records as JSON text, by id."""
    import json

    from pyspark.sql import functions as F

    def read(df):
        return [json.loads(row[0]) for row in df.orderBy("id").select(F.to_json("rec")).collect()]

    return read
