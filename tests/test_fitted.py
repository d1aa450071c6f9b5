from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from panelforge.operators import anomaly, cleaning, timeseries
from panelforge.operators.fitted import Climatology, Fences, IsolationForest, IsolationForestModel, Scaling


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2)) * [1, 50]
    x[:4] = [[9, 0], [0, 900], [-9, 0], [8, 800]]
    rows = [(i, float(a), float(b), 3.0) for i, (a, b) in enumerate(x)] + [(400, None, 1.0, 3.0)]
    return spark.createDataFrame(rows, "id long, a double, `b.c` double, same double")


def test_stages_apply_what_the_operators_compute(points):
    names = ["a", "b.c", "same"]
    fences, scaling = Fences(columns=names, multiplier=1.0).fit(points), Scaling(columns=names).fit(points)
    assert sorted_rows(fences.transform(points)) == sorted_rows(cleaning.winsorize(points, names, multiplier=1.0, hard={}))
    assert sorted_rows(scaling.transform(points)) == sorted_rows(cleaning.standardize(points, names))
    # Another table meets the fitted state, not its own.
    other = points.where("id = 1")
    want = [r for r in sorted_rows(scaling.transform(points)) if r[0] == 1]
    assert sorted_rows(scaling.transform(other)) == want


def test_saved_pipeline_gives_equal_rows(spark, points, tmp_path):
    names = ["a", "b.c"]
    stages = [Fences(columns=names), Scaling(columns=names), IsolationForest(ids=["id"], columns=names, trees=20, sample=64, contamination=0.02)]
    pipeline = Pipeline(stages=stages)
    pipeline.write().overwrite().save(f"{tmp_path}/unfitted")
    model = Pipeline.load(f"{tmp_path}/unfitted").fit(points)
    model.write().overwrite().save(f"{tmp_path}/fitted")
    model.write().overwrite().save(f"{tmp_path}/fitted")
    loaded = PipelineModel.load(f"{tmp_path}/fitted")
    assert sorted_rows(loaded.transform(points)) == sorted_rows(model.transform(points))
    assert sorted_rows(loaded.transform(points)) == sorted_rows(pipeline.fit(points).transform(points))
    forest = loaded.stages[-1]
    assert isinstance(forest, IsolationForestModel) and forest.getOrDefault("trees") == 20 and forest.uid == model.stages[-1].uid
    with pytest.raises(Exception):
        model.save(f"{tmp_path}/fitted")


def test_forest_flags_equal_the_operator(points):
    names = ["a", "same"]
    args = {"trees": 20, "sample": 64, "contamination": 0.05}
    got = IsolationForest(ids=["id"], columns=names, **args).fit(points).transform(points)
    assert sorted_rows(got) == sorted_rows(anomaly.isolation_forest(points, ["id"], names, **args))
    assert [(r.score, r.outlier_iforest) for r in got.where("id = 400").collect()] == [(None, False)]


def test_climatology_of_earlier_years(spark, tmp_path):
    rows = [(s, date(2021, 1, 1) + timedelta(days=i), float(i % 365 + n)) for n, s in enumerate("xy") for i in range(800)]
    daily = spark.createDataFrame(rows, "s string, date date, v double")
    past = daily.where("date < '2022-12-31'")
    model = Climatology(value="v", series=["s"], date="date").fit(past)
    model.save(f"{tmp_path}/m")
    loaded = type(model).load(f"{tmp_path}/m")
    columns = ["s", "date", "v", "day_of_year", "baseline", "anomaly"]
    assert sorted_rows(loaded.transform(past).select(columns)) == sorted_rows(timeseries.anomalies(past, "v", ["s"]).select(columns))
    unknown = spark.createDataFrame([("z", date(2023, 1, 1), 1.0)], "s string, date date, v double")
    assert [(r.baseline, r.anomaly) for r in loaded.transform(unknown).collect()] == [(None, None)]


def test_empty_and_missing(spark, points, tmp_path):
    empty = points.limit(0)
    assert Scaling(columns=["a"]).fit(empty).transform(points).where("a is not null").count() == 0
    assert sorted_rows(Fences(columns=["a"]).fit(empty).transform(points)) == sorted_rows(points)
    assert Scaling(columns=["a"]).fit(points).transform(empty).collect() == []
    with pytest.raises(AttributeError):
        Scaling(colums=["a"])


def test_depths_are_looked_up_as_the_trees_give_them(spark, monkeypatch):
    import numpy as np

    from panelforge.operators import anomaly

    r = np.random.default_rng(4)
    data = [(i, float(r.normal()), float(r.integers(0, 9)), float(r.exponential())) for i in range(3000)]
    data += [(-1, None, 1.0, 2.0), (-2, float("inf"), -1e9, 0.0)]
    df = spark.createDataFrame(data, "id long, a double, b double, c double").cache()
    names = ["a", "b", "c"]
    nodes = anomaly.fit_isolation_forest(df.where("id >= 0"), ["id"], names, trees=12).cache()
    made, build = [], anomaly.depth_tables
    monkeypatch.setattr(anomaly, "depth_tables", lambda *a: made.append(build(*a)) or made[-1])

    def scores():
        return {x.id: x.score for x in anomaly.isolation_scores(df, names, nodes).collect()}

    by_table = scores()
    monkeypatch.setattr(anomaly, "MOST_CELLS", 0)
    assert by_table == scores() and by_table[-1] is None and by_table[-2] is not None
    assert all(made[0][1]) and not any(made[1][1])
