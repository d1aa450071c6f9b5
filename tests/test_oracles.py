"""Every query with SQL must give what DuckDB gives; the others must give rows."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracles import connect, difference  # noqa: E402

FOLDER = os.environ.get("PANELFORGE_TABLES", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

# Fits that take long; tests/test_models.py covers them on small frames.
SLOW = {"fc_all_models", "fc_tree", "ml_kmeans", "ml_detector_report", "ts_stl_trend"}


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    return connect(FOLDER)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_gives_the_flagship(spark):
    assert entry.entry(spark).columns == ["n_name", "price", "balance", "latitude", "observations"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(got, duck.execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_gives_rows(spark, duck, name):
    assert len(QUERIES[name](spark, FOLDER).limit(5).collect()) > 0
