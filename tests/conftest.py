from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelforge.session import clear_scratch, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "tests", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """DataFrame from a schema text and tuples."""

    def make(schema: str, *data):
        return spark.createDataFrame([tuple(d) for d in data], schema)

    return make
