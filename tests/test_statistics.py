"""Numbers that have known values: p-values, Shapley sums, stacking with gaps, sinks."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions.stats import line_p_value, log_gamma
from panelforge.operators import ensemble, importance, trees
from panelforge.sources import write_parquet


def simpson_tail(t, df):
    """Two-sided tail of Student's t, by integrating its density over the substitution x = sqrt(df) tan u."""
    a, b, n = math.atan(t / math.sqrt(df)), math.pi / 2, 20000
    u = np.linspace(a, b, n + 1)
    y = np.cos(u) ** (df - 1)
    area = (b - a) / n / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 2 * scale * area


@pytest.mark.parametrize("n", [3, 6, 30, 1000, 20000])
def test_p_value_of_a_line(spark, n):
    r2 = [0.0, 1e-6, 0.001, 0.05, 0.3, 0.784, 0.99]
    got = [r.p for r in spark.createDataFrame([(x, n) for x in r2], "r2 double, n long").select(line_p_value(F.col("r2"), F.col("n")).alias("p")).collect()]
    for x, p in zip(r2, got):
        want = simpson_tail(math.sqrt(x * (n - 2) / (1 - x)), n - 2)
        assert p == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_p_value_edges(spark):
    df = spark.createDataFrame([(1.0, 10), (0.5, 2), (None, 9)], "r2 double, n long")
    assert [r.p for r in df.select(line_p_value(F.col("r2"), F.col("n")).alias("p")).collect()] == [0.0, None, None]


def test_log_gamma(spark):
    xs = [0.5, 1.0, 2.5, 10.0, 1e5]
    got = [r.g for r in spark.createDataFrame([(x,) for x in xs], "x double").select(log_gamma(F.col("x")).alias("g")).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-11, abs=1e-11)


@pytest.fixture(scope="module")
def fitted(spark):
    r = np.random.default_rng(0)
    x = r.random((300, 4))
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0.5, x[:, 2], 0) + 0.1 * r.normal(size=300)
    df = trees.assemble(spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, label double"), ["a", "b", "c", "d"])
    return df


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_shapley_values_add_up(fitted, kind):
    make = trees.forest(numTrees=10, seed=1, maxDepth=7) if kind == "forest" else trees.boosting(maxIter=8, seed=1)
    model = make.fit(fitted)
    rows = importance.shap_values(model, model.transform(fitted), ["a", "b", "c", "d"]).collect()
    assert max(abs(sum(r.shap) + r.base_value - r.prediction) for r in rows) < 1e-9


def test_permutation_uses_all_rows(fitted):
    model = trees.forest(numTrees=10, seed=1, maxDepth=6).fit(fitted)
    got = {r.feature: r.importance for r in importance.permutation_importance(model, fitted, ["id"], ["a", "b", "c", "d"]).collect()}
    assert got["a"] > got["b"] > got["d"] and abs(got["d"]) < 0.05


def test_stacking_with_a_missing_model(spark):
    rows = []
    for day in range(12):
        for model, shift in (("A", 0.5), ("B", -1.0)):
            if not (day == 1 and model == "B"):
                rows.append(("k", day, model, float(day), day + shift, day < 8))
    df = spark.createDataFrame(rows, "k string, date int, model string, y_true double, y_pred double, is_blend boolean")
    got = ensemble.stacking(df, ["k"]).collect()
    assert len(got) == 4 and all(abs(r.y_pred - r.y_true) < 0.5 for r in got)
    assert [(r.date, r.models) for r in ensemble.unstacked(df, ["k"]).collect()] == [(1, ["B"])]


def test_files_do_not_grow_with_the_tasks(spark, tmp_path):
    df = spark.range(4000).selectExpr("id % 4 AS part", "id")
    counts = []
    for n in ("4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        write_parquet(df, f"{tmp_path}/{n}", sort=["id"], partition_by=["part"])
        counts.append(sum(f.endswith(".parquet") for _, _, names in os.walk(f"{tmp_path}/{n}") for f in names))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert counts[1] <= counts[0] + 16 and counts[1] < 4 * 16
