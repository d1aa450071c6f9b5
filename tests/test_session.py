"""Scratch tables and the way of the package to the workers."""

import os
import subprocess
import sys

import pytest

from panelforge import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

APART = """
import sys; sys.path.insert(0, sys.argv[1])
from panelforge.session import local_session, ship
spark = local_session(2, "apart")
ship(spark)
sys.path.remove(sys.argv[1])
from panelforge.operators.anomaly import isolation_forest
df = spark.range(300).selectExpr("id", "CAST(id % 17 AS DOUBLE) AS x", "CAST(id % 5 AS DOUBLE) AS y")
print("rows", isolation_forest(df, ["id"], ["x", "y"], trees=5).count())
"""


def test_workers_get_the_package(tmp_path):
    """A session started in another folder, whose workers do not have this one on their path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", APART, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 300" in got.stdout, got.stderr[-2000:]


def test_scratch_is_shared_and_goes(spark):
    own = session._MADE.setdefault(spark.sparkContext.applicationId, [])
    before, own[:] = list(own), []  # what other tests still read stays
    assert session.durable(spark.range(5).toDF("x")).count() == 5
    path = session._MADE[spark.sparkContext.applicationId][0]
    assert path.startswith(session.shared_folder(spark)) and os.path.isdir(path.removeprefix("file:"))
    session.clear_scratch(spark)
    assert not os.path.exists(path.removeprefix("file:"))
    session._MADE[spark.sparkContext.applicationId] = before


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, name, other=None):
            return other if "checkpoint" in name else "file:/tmp/warehouse"

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_folder(Session())
