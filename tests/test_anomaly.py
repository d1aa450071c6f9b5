import numpy as np
import pytest

from panelforge.operators import anomaly


def brute_noise(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    return ~(near & core[None]).any(1)


def frame(spark, x):
    data = [(i, *map(float, p)) for i, p in enumerate(x)]
    names = [f"f{j}" for j in range(x.shape[1])]
    return spark.createDataFrame(data, ", ".join(["id int", *[f"{n} double" for n in names]])), names


def check(spark, x, eps, least):
    df, names = frame(spark, x)
    out = anomaly.dbscan_noise(df, ["id"], names, eps, least).toPandas().sort_values("id")
    want = brute_noise(x, eps, least)
    assert out["is_noise"].tolist() == want.tolist()
    return want


def test_noise_equals_brute_force_with_a_crowded_cell(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(500, 2)), np.full((300, 2), 0.25), rng.uniform(-6, 6, (80, 2))])
    want = check(spark, x, 0.4, 8)
    assert 0 < want.sum() < len(x)


def test_noise_in_six_dimensions(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 6)) * 0.6, rng.uniform(-3, 3, (40, 6))])
    want = check(spark, x, 1.2, 10)
    assert 0 < want.sum() < len(x)


def test_noise_at_exact_distance_and_border_points(spark):
    line = np.array([[0.0], [1.0], [2.0], [3.0], [4.5], [10.0]])
    # 3 is a border point of core 2; 4.5 has one neighbour too few; 10 is alone.
    assert check(spark, line, 1.0, 3).tolist() == [False, False, False, False, True, True]


def test_forest_flags_planted_outliers_at_the_wanted_rate(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(1990, 3)), rng.normal(size=(10, 3)) + 8])
    df, names = frame(spark, x)
    out = anomaly.isolation_forest(df, ["id"], names, 0.01, trees=60).toPandas().sort_values("id")
    assert out["outlier_iforest"].sum() == 20
    assert out["outlier_iforest"].tail(10).all()
    again = anomaly.isolation_forest(df.repartition(7), ["id"], names, 0.01, trees=60)
    assert np.allclose(again.toPandas().sort_values("id")["score"], out["score"])


def test_trees_get_their_samples_from_small_and_large_tables(spark):
    for n in (50, 3000):
        df = spark.range(n)
        per = anomaly.tree_samples(df, ["id"], 10, 64, 1).groupBy("tree").count().collect()
        assert len(per) == 10 and all(r["count"] == min(n, 64) for r in per)


def test_missing_features_are_no_outliers(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(200)] + [(999, None)], "id int, v double")
    out = anomaly.isolation_forest(df, ["id"], ["v"], trees=10)
    missing = out.where("id = 999").first()
    assert missing.score is None and missing.outlier_iforest is False


def test_average_depth():
    assert anomaly.average_depth(1) == 0 and anomaly.average_depth(2) == 1
    assert float(anomaly.average_depth(256)) == pytest.approx(10.2448, abs=1e-3)


def met(spark, n, dims, leaf):
    """Cells of ``n`` points that fill more room the more they are, and the pairs that the boxes bring together."""
    rng = np.random.default_rng(n)
    x = rng.integers(0, 4 * n ** (1 / dims) + 1, (n, dims))
    x[: n // 10, 0] = x[:, 0].max() + 40  # many cells at the end of an axis
    x = np.unique(x, axis=0)
    cells = spark.createDataFrame([(r.tolist(), 1, True) for r in x], "_cell array<long>, _n long, _thin boolean")
    return x, anomaly._met(cells, dims, 3, leaf)


def test_boxes_bring_every_near_pair_together_once(spark):
    for dims in (1, 2, 6):
        x, pairs = met(spark, 400, dims, 16)
        got = [(tuple(r[0]), tuple(r[1])) for r in pairs.select("_cell", "_other").collect()]
        assert len(got) == len(set(got))
        want = {(tuple(a), tuple(b)) for a in x.tolist() for b in x[(np.abs(x - a) <= 3).all(1)].tolist()}
        assert want <= set(got)


def test_pairs_of_cells_grow_with_the_points_in_six_dimensions(spark):
    small, large = (met(spark, n, 6, 32)[1].count() / n for n in (500, 4000))
    assert large < 3 * small and large < 4000 / 4


def test_points_with_enough_neighbours_in_their_block_need_no_cells(spark, monkeypatch):
    monkeypatch.setattr(anomaly, "TOGETHER", 300)
    r = np.random.default_rng(8)
    x = np.vstack([r.normal(size=(1500, 4)), r.uniform(-9, 9, (60, 4))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, a double, b double, c double, d double")
    asked, pairs = [], anomaly._cell_pairs
    monkeypatch.setattr(anomaly, "_cell_pairs", lambda cells, *a: asked.append(cells) or pairs(cells, *a))
    got = {v.id for v in anomaly.dbscan_noise(df, ["id"], ["a", "b", "c", "d"], eps=1.0, min_samples=8).where("is_noise").collect()}
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 1.0
    core = near.sum(axis=1) >= 8
    assert got == set(np.flatnonzero(~(near & core).any(axis=1)).tolist())
    found = asked[0].collect()
    small, thin = sum(c._n < 8 for c in found), sum(c._thin for c in found)
    assert 0 < thin < small / 2
