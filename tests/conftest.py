import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from recordlens.session import local_session

    shared = f"file://{tmp_path_factory.mktemp('shared')}"
    session = local_session("4", 4, **{"spark.checkpoint.dir": shared})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


RECORD = (
    "record_id string, server_slug string, name string, description string, "
    "input_schema string, category string, split string"
)


@pytest.fixture
def records(spark):
    """Build records from (id, group, name, description, schema, label, split) tuples."""
    return lambda rows: spark.createDataFrame(rows, RECORD)
