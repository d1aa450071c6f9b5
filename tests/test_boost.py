import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import boost, importance
from panelforge.operators.trees import assemble

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(5)
    data = []
    for i in range(300):
        a, b, c = float(r.integers(0, 30)), float(r.normal()), float(r.integers(0, 4))
        data.append((i, a, b, c, float(round(3 * a + 8 * (b > 0) * c + r.normal(), 2))))
    df = spark.createDataFrame(data, "id long, a double, b double, c double, label double").repartition(3)
    return assemble(df, NAMES).select("id", "features", "label").cache()


def split(bins, r, rows, used, least, ridge):
    """The best split of the rows, tried one by one."""
    score = lambda s: r[s].sum() ** 2 / (len(s) + ridge)
    best = None
    for f in used:
        for b in range(int(bins[f].max()) + 1):
            left, right = rows[bins[f, rows] <= b], rows[bins[f, rows] > b]
            if len(left) >= least and len(right) >= least:
                gain = score(left) + score(right) - score(rows)
                if gain > 1e-10 * score(rows) and (best is None or gain > best[0] + 1e-9):
                    best = (gain, left, right)
    return best


def brute(bins, key, y, rounds, rate, depth, leaves, least, ridge, share, columns, seed):
    """Plain boosting: best-first by a list of all leaves, or level by level."""
    f_x = np.full(len(y), y.mean())
    for number in range(rounds):
        r = y - f_x
        drawn = np.flatnonzero(boost.kept(key, number, seed, share))
        used = boost.drawn_features(len(bins), number, seed, columns)
        parts = [(drawn, np.arange(len(y)), 0)]

        def cut(i):
            rows, every, level = parts[i]
            found = split(bins, r, rows, used, least, ridge)
            if found is None or (depth is not None and level >= depth):
                return None
            f, b = next((f, b) for f in used for b in range(32) if np.array_equal(rows[bins[f, rows] <= b], found[1]))
            on = bins[f, every] <= b
            return found[0], [(found[1], every[on], level + 1), (found[2], every[~on], level + 1)]

        while leaves is None or len(parts) < leaves:
            able = [(c[0], -i, c[1]) for i in range(len(parts)) if (c := cut(i))]
            if not able:
                break
            _, i, children = max(able, key=lambda v: v[:2])
            del parts[-i]
            parts += children
        for rows, every, _ in parts:
            f_x[every] += rate * r[rows].sum() / (len(rows) + ridge)
    return f_x


@pytest.mark.parametrize("depth,leaves,rounds,finish", [(3, None, 13, 0), (None, 6, 23, 0), (None, 12, 4, 0), (3, None, 13, 300), (None, 12, 5, 300)])
def test_equals_plain_boosting(spark, points, monkeypatch, depth, leaves, rounds, finish):
    monkeypatch.setattr(boost, "ROWS", 90)
    model = boost.fit(points, 3, ["id"], rounds=rounds, rate=0.3, depth=depth, leaves=leaves, least=5, columns=0.7, seed=2, finish=finish)
    rows = points.withColumn("k", F.xxhash64("id")).collect()
    x, y, key = np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows]), np.array([r.k for r in rows], np.int64)
    want = brute(boost.binned(x, model.cuts), key, y, rounds, 0.3, depth, leaves, 5, 1.0, 0.9, 0.7, 2)
    got = {r.id: r.prediction for r in model.transform(points).collect()}
    assert [got[r.id] for r in rows] == pytest.approx(want.tolist(), abs=1e-6)
    if leaves:
        assert all((t.feature < 0).sum() <= leaves for t in model.trees) and max((t.feature < 0).sum() for t in model.trees) == leaves


def test_saved_model_gives_the_same(spark, points, tmp_path):
    model = boost.fit(points, 3, ["id"], rounds=4, depth=3)
    again = boost.Boosted.load(spark, model.save(spark, str(tmp_path / "m")))
    a, b = [{r.id: r.prediction for r in m.transform(points).collect()} for m in (model, again)]
    assert a == b
    found = boost.importances(model, NAMES, spark).collect()
    assert found[0].feature == "a" and sum(r.importance for r in found) == pytest.approx(1)


def test_shapley_values_add_up(spark, points):
    model = boost.fit(points, 3, ["id"], rounds=6, leaves=7, rate=0.3)
    out = importance.shap_values(model, model.transform(points), NAMES).collect()
    assert all(sum(r.shap) + r.base_value == pytest.approx(r.prediction, abs=1e-6) for r in out)


def test_odd_rows(spark, points):
    odd = points.unionByName(points.limit(3).withColumn("label", F.lit(None).cast("double"))).unionByName(
        points.limit(2).withColumn("features", F.lit(None).cast(points.schema["features"].dataType))
    )
    model = boost.fit(points, 3, ["id"], rounds=2, depth=2)
    rows = model.transform(odd).collect()
    assert len(rows) == 305 and sum(r.prediction is None for r in rows) == 2
    empty = boost.fit(points.limit(0), 3, ["id"], rounds=2, depth=2)
    assert empty.trees == [] and all(r.prediction is None for r in empty.transform(points.limit(3)).collect())
    with pytest.raises(ValueError):
        boost.fit(points, 3, ["id"])
    flat = boost.fit(points.withColumn("label", F.lit(4.0)), 3, ["id"], rounds=2, leaves=5)
    assert {r.prediction for r in flat.transform(points).collect()} == {4.0}


@pytest.mark.parametrize("depth,leaves,rounds", [(3, None, 13), (None, 12, 5)])
def test_cells_groups_and_passes_give_the_same(spark, points, monkeypatch, depth, leaves, rounds):
    monkeypatch.setattr(boost, "ROWS", 90)
    monkeypatch.setattr(boost, "SUMMED", 12_000)  # a few rounds at a time
    monkeypatch.setattr(boost, "CHUNK", 50)  # cells that lie in several chunks
    ways = {"cells": {"finish": 0}, "group": {"grid": 0}, "passes": {"finish": 0, "grid": 0}}
    asked, over_cells = [], boost._by_cells
    monkeypatch.setattr(boost, "_by_cells", lambda *a: asked.append(1) or over_cells(*a))
    copies = points.unionByName(points.withColumns({"id": F.col("id") + 1000, "label": F.col("label") + 1}))
    got = {}
    for way, settings in ways.items():
        model = boost.fit(copies, 3, ["id"], rounds=rounds, rate=0.3, depth=depth, leaves=leaves, least=5, columns=0.7, seed=2, **settings)
        got[way] = [r.prediction for r in model.transform(copies).orderBy("id").collect()]
    assert got["cells"] == pytest.approx(got["group"]) and got["cells"] == pytest.approx(got["passes"]) and len(asked) == 1


def test_rounds_do_not_ask_for_the_rows(spark, points):
    before = boost.fit(points, 3, ["id"], rounds=3, depth=3, finish=0)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("rounds", "rounds")
    boost.fit(points, 3, ["id"], rounds=60, depth=3, finish=0)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(before.trees) == 3 and len(jobs.getJobIdsForGroup("rounds")) < 40


def test_table_of_cells_scores_as_the_trees_do(points, monkeypatch):
    model = boost.fit(points, 3, ["id"], rounds=9, leaves=7, rate=0.3)
    x = np.vstack([np.random.default_rng(1).normal(5, 9, (400, 3)), [[np.nan, 0.0, 1.0], [np.inf, -np.inf, np.nan]]])
    by_table = model.score(x)
    monkeypatch.setattr(boost, "GRID", 0)
    assert by_table.tolist() == model.score(x).tolist()
