import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import forest as f
from panelforge.operators.trees import assemble


def brute(bins, w, y, leaf, depth):
    """Prediction function of a tree grown node by node."""
    total, cover = float((w * y).sum()), float(w.sum())
    best = (f.LEAST_GAIN * total * total / cover, None, None)
    if depth and len(w) >= 2 * leaf:
        for j in range(len(bins)):
            for cut in range(int(bins[j].max())):
                on = bins[j] <= cut
                if on.sum() >= leaf and (~on).sum() >= leaf:
                    a, b, p, q = (w * y)[on].sum(), (w * y)[~on].sum(), w[on].sum(), w[~on].sum()
                    gain = a * a / p + b * b / q - total * total / cover
                    if gain > best[0]:
                        best = (gain, j, cut)
    if best[1] is None:
        return lambda x: total / cover
    on = bins[best[1]] <= best[2]
    left, right = brute(bins[:, on], w[on], y[on], leaf, depth - 1), brute(bins[:, ~on], w[~on], y[~on], leaf, depth - 1)
    return lambda x: left(x) if x[best[1]] <= best[2] else right(x)


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(3)
    data = [(i, float(r.integers(0, 40)), float(r.normal()), float(r.integers(0, 3)), float(r.integers(0, 50))) for i in range(200)]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, label double").repartition(3)
    return assemble(df, ["a", "b", "c"]).select("id", "features", "label").cache()


@pytest.mark.parametrize("finish,leaf,depth", [(10**6, 2, 30), (25, 2, 30), (1, 3, 4), (60, 1, 3)])
def test_equals_growth_node_by_node(spark, points, finish, leaf, depth):
    grown = f.grow(points, 3, ["id"], trees=5, leaf=leaf, depth=depth, finish=finish, seed=7)
    assert (grown.levels > 0) == (finish < 200)
    got = {r.id: r.prediction for r in f.predict(grown, points).collect()}
    rows = points.withColumn("k", F.xxhash64("id")).collect()
    x, y, key = np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows]), np.array([r.k for r in rows], np.int64)
    bins = f.binned(x, grown.cuts)
    trees = []
    for t in range(5):
        w = f.draws(key, t, 7).astype(float)
        trees.append(brute(bins[:, w > 0], w[w > 0], y[w > 0], leaf, depth))
    for i, r in enumerate(rows):
        assert got[r.id] == pytest.approx(np.mean([t(bins[:, i]) for t in trees]), abs=1e-9)


def test_importances_do_not_depend_on_where_trees_are_finished(points):
    a, b = [f.importances(f.grow(points, 3, ["id"], trees=6, finish=n), ["a", "b", "c"]).collect() for n in (10**6, 30)]
    assert [r.feature for r in a] == [r.feature for r in b] and sum(r.importance for r in a) == pytest.approx(1)
    assert [r.importance for r in a] == pytest.approx([r.importance for r in b])


def test_blocks_of_a_level_are_filled_up_and_bounded(spark, points, monkeypatch):
    monkeypatch.setattr(f, "BLOCK", 16)
    grown = f.grow(points, 3, ["id"], trees=2, finish=40)
    again = f.grow(points.repartition(7), 3, ["id"], trees=2, finish=10**6)
    key = lambda df: sorted((r.id, round(r.prediction, 9)) for r in df.collect())
    assert key(f.predict(grown, points)) == key(f.predict(again, points))


def test_draws_are_poisson():
    n = f.draws(np.arange(200_000), 3, 1)
    assert abs(n.mean() - 1) < 0.01 and abs(n.var() - 1) < 0.02 and (f.draws(np.arange(9), 0, 1) != f.draws(np.arange(9), 1, 1)).any()


def test_odd_rows(spark):
    data = [(1, 1.0, float("nan"), 5.0), (2, None, 2.0, 7.0), (3, 3.0, 2.0, None), (None, 4.0, 2.0, 1.0), (1, 1.0, float("nan"), 5.0)]
    df = spark.createDataFrame(data * 4, "id long, a double, b double, label double").fillna(0.0, ["a"])
    from pyspark.ml.functions import array_to_vector

    df = df.select("id", array_to_vector(F.array("a", "b")).alias("features"), "label")
    out = f.predict(f.grow(df, 2, ["id"], trees=3, leaf=1), df).collect()
    assert len(out) == 20 and all(r.prediction is not None for r in out)
    empty = f.predict(f.grow(df.limit(0), 2, ["id"], trees=3), df).collect()
    assert len(empty) == 20 and all(r.prediction is None for r in empty)
    same = f.grow(df.withColumn("label", F.lit(2.0)), 2, ["id"], trees=2, finish=1)
    assert {r.prediction for r in f.predict(same, df).collect()} == {2.0}


def test_rows_of_equal_bins_are_kept_and_scored_once(spark, points, monkeypatch):
    copies = points.crossJoin(spark.range(8).withColumnRenamed("id", "copy"))
    written, write = [], f.durable
    monkeypatch.setattr(f, "durable", lambda df: written.append(write(df)) or written[-1])
    grown = f.grow(copies, 3, ["id", "copy"], trees=5, finish=40)
    cells = len(np.unique(f.binned(np.array([r.features.toArray() for r in points.collect()]), grown.cuts), axis=1).T)
    first = next(df for df in written if "s" in df.columns)
    assert first.agg(F.sum("n")).first()[0] <= 5 * (cells + 20) < 0.63 * 5 * copies.count()
    out = f.predict(grown, copies).collect()
    scored = next(df for df in written if "ids" in df.columns)
    assert len(out) == copies.count() and scored.agg(F.sum(F.length("ids") / 8)).first()[0] == cells
