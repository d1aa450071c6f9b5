import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import boost, importance
from panelforge.operators.trees import assemble

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(5)
    data = [(i, float(a := r.integers(0, 30)), float(r.normal()), float(c := r.integers(0, 4)), float(3 * a + 8 * c)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, label double").repartition(3)
    return assemble(df, NAMES).select("id", "features", "label").cache()


def test_equal_bins_are_explained_once(spark, points, monkeypatch):
    model = boost.fit(points, 3, ["id"], rounds=6, leaves=7, rate=0.3)
    copies = points.unionByName(points).unionByName(points.limit(1).withColumn("features", F.lit(None).cast(points.schema["features"].dataType)))
    made, written = [], importance.durable
    monkeypatch.setattr(importance, "durable", lambda df: made.append(written(df)) or made[-1])
    out = importance.shap_values(model, model.transform(copies), NAMES).collect()
    bins = {tuple(b) for b in boost.binned(np.array([r.features.toArray() for r in out if r.features]), model.cuts).T}
    assert len(out) == 601 and sum(r.shap is None for r in out) == 1 and made[0].count() == len(bins) < 601
    assert all(sum(r.shap) + r.base_value == pytest.approx(r.prediction, abs=1e-6) for r in out if r.shap)
    # A long path is worked out by its polynomial, and agrees.
    monkeypatch.setattr(importance, "MOST_PLAYERS", 1)
    again = {r.id: r.shap for r in importance.shap_values(model, points, NAMES).collect()}
    assert all(r.shap == pytest.approx(again[r.id], abs=1e-6) for r in out if r.shap)
