import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import additive, arima, cluster, ensemble, forecast, importance, trees
from panelforge.sources import read_model, scratch_path, write_model

START = dt.date(2021, 1, 1)


def simulate(n=900, seed=0, ar=(0.6, -0.3)):
    rng = np.random.default_rng(seed)
    w, e = np.zeros(n), rng.normal(size=n)
    for t in range(2, n):
        w[t] = ar[0] * w[t - 1] + ar[1] * w[t - 2] + e[t]
    return w


def daily(spark, series):
    data = [(k, START + dt.timedelta(days=i), float(v)) for k, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(data, "s string, date date, v double")


def test_arima_recovers_an_autoregression():
    found = arima.fit(simulate(4000), (2, 0, 0))
    assert found == pytest.approx([0.6, -0.3], abs=0.05)
    w, e = np.zeros(4000), np.random.default_rng(1).normal(size=4000)
    w[1:] = e[1:] + 0.5 * e[:-1]
    assert arima.fit(w, (0, 0, 1)) == pytest.approx([0.5], abs=0.05)


def test_seasonal_lags_multiply():
    ar, ma = arima.polynomials(np.array([0.5, 0.2, 0.4, 0.1]), (1, 1, 1), (1, 1, 1), 7)
    assert ar[[0, 1, 7, 8]] == pytest.approx([1, -0.5, -0.4, 0.2]) and len(ar) == 9
    assert ma[[0, 1, 7, 8]] == pytest.approx([1, 0.2, 0.1, 0.02])


@pytest.mark.parametrize("seasonal,period", [((0, 0, 0), 0), ((1, 1, 1), 7)])
def test_one_step_predictions_ignore_the_future(seasonal, period):
    y = 50 + np.cumsum(simulate(300)) + 3 * np.sin(np.arange(300) * 2 * np.pi / 7)
    first, width = arima.backtest(y, 30, (1, 1, 1), seasonal, period)
    changed = y.copy()
    changed[285:] += 1000
    second, _ = arima.backtest(changed, 30, (1, 1, 1), seasonal, period)
    np.testing.assert_allclose(first[:16], second[:16], atol=1e-6)
    assert np.mean(np.abs(y[270:] - first) < width) > 0.8


def test_short_series_repeat_the_last_value():
    predicted, _ = arima.backtest(np.arange(12.0), 3, (2, 1, 2))
    assert predicted.tolist() == [8.0, 9.0, 10.0]


def test_additive_curve_follows_trend_week_and_year():
    days = np.arange(18262.0, 18262 + 900)
    truth = 20 + 0.01 * np.arange(900) + 5 * np.sin(2 * np.pi * days / 365.25) + np.cos(2 * np.pi * days / 7)
    y = truth + np.random.default_rng(2).normal(scale=0.3, size=900)
    curve, width = additive.fit_predict(days[:810], y[:810], days[810:])
    assert np.abs(curve - truth[810:]).mean() < 0.4
    assert np.mean(np.abs(y[810:] - curve) < width) > 0.85
    assert width[-1] >= width[0] > 0


def test_forecasters_share_one_layout(spark):
    df = daily(spark, {"a": 10 + simulate(150), "b": 20 + simulate(150, 1), "tiny": [1.0, 2.0, 3.0]})
    for make in (forecast.arima_forecast, forecast.sarima_forecast, forecast.additive_forecast, forecast.baselines):
        out = make(df, "v", ["s"], 20)
        assert {"s", "date", "model", "y_true", "y_pred", "lo", "hi"} == set(out.columns)
        per = {r["s"]: r["count"] for r in out.where("s <> 'tiny'").groupBy("s", "model").count().collect()}
        assert per == {"a": 20, "b": 20}
    metrics = forecast.backtest_metrics(forecast.arima_forecast(df, "v", ["s"], 20), ["s"])
    assert {r.s for r in metrics.collect()} == {"a", "b", "tiny"}


def test_short_series_have_the_same_test_days_and_no_other_model(spark):
    df = daily(spark, {"a": 10 + simulate(150), "tiny": [1.0, 2.0, 3.0], "one": [5.0]})
    days = {(r.s, r.date) for r in forecast.baselines(df, "v", ["s"], 20).select("s", "date").collect()}
    small = {"RandomForest": {"trees": 2, "depth": 3}}
    out = forecast.all_models(df, "v", ["s"], 20, trees=small, reason=True).cache()
    for model in ("ARIMA", "SARIMA", "Additive", "RandomForest"):
        rows = out.where(F.col("model") == model).collect()
        assert {(r.s, r.date) for r in rows} == days and len(rows) == 24
        assert all((r.y_pred is None) == (r.s != "a") == (r.reason is not None) and r.y_true is not None for r in rows)
    metrics = {(r.s, r.model): r for r in forecast.backtest_metrics(out, ["s"]).collect()}
    assert len(metrics) == 12 and metrics["a", "ARIMA"].n == 20 and metrics["a", "ARIMA"].rmse > 0
    assert metrics["one", "ARIMA"].n == 0 and metrics["one", "ARIMA"].rmse is None and "needed" in metrics["one", "ARIMA"].reason


def test_future_outlook_covers_history_and_horizon(spark):
    out = forecast.future_outlook(daily(spark, {"a": 10 + simulate(120)}), "v", ["s"], 30).toPandas()
    assert len(out) == 150 and out["ds"].max() == START + dt.timedelta(days=149)
    assert (out["yhat_lower"] < out["yhat"]).all() and (out["yhat"] < out["yhat_upper"]).all()


def test_tree_forecast_beats_the_mean(spark):
    y = 10 + 5 * np.sin(np.arange(400) * 2 * np.pi / 7)
    out = forecast.tree_forecast(daily(spark, {"a": y}), "v", ["s"], "RandomForest", 30, trees=10)
    r = forecast.backtest_metrics(out, ["s"]).first()
    assert r.n == 30 and r.r2 > 0.8


SIZES = {
    "forecast forest": {"trees": 400, "leaf": 2}, "forecast levels": {"rounds": 600, "rate": 0.03, "depth": 4},
    "forest": {"trees": 200, "leaf": 3}, "levels": {"rounds": 500, "rate": 0.05, "depth": 6},
    "leaves": {"rounds": 600, "rate": 0.03, "leaves": 31, "least": 20},
}
USES = {
    "fc_tree": {"forecast forest", "forecast levels", "leaves"}, "fc_all_models": {"forecast forest", "forecast levels", "leaves"},
    "ml_random_forest": {"forest"}, "ml_gbt": {"levels"}, "ml_leaf_boosting": {"leaves"}, "fi_tree": {"levels", "forest"},
    "fi_permutation": {"levels"}, "fi_shap": {"levels"}, "fi_shap_dependence": {"levels"}, "io_model_roundtrip": {"levels"},
}


@pytest.mark.parametrize("name", sorted(USES))
def test_registered_fits_have_the_full_size(spark, name, monkeypatch):
    from panelforge.operators import boost, forest
    from panelforge.plans import QUERIES

    class Stop(Exception):
        pass

    seen = []

    def stopped(*args, seed=42, **sizes):
        seen.append(sizes)
        raise Stop

    monkeypatch.setattr(forest, "grow", stopped)
    monkeypatch.setattr(boost, "fit", stopped)
    with pytest.raises(Stop):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen and all(any(got == SIZES[u] for u in USES[name]) for got in seen)


@pytest.fixture(scope="module")
def predictions(spark):
    """Nine days and four models; RMSE on the first three days is 1, 1, 2 and 4."""
    data = []
    for i in range(9):
        for model, off in (("B", 1.0), ("A", -1.0), ("C", 2.0), ("D", 4.0)):
            data.append(("s", START + dt.timedelta(days=i), model, float(i), i + off * (1 if i % 2 else -1)))
    return spark.createDataFrame(data, "s string, date date, model string, y_true double, y_pred double")


def test_ensembles_by_hand(predictions):
    marked = ensemble.split(predictions, ["s"])
    assert marked.where("is_blend").count() == 3 * 4
    top = {r.model: (r["rank"], r.weight) for r in ensemble.select_top(marked, ["s"]).collect()}
    assert top["A"] == (1, pytest.approx(0.4)) and top["B"] == (2, pytest.approx(0.4))
    assert top["C"] == (3, pytest.approx(0.2)) and "D" not in top
    chosen = ensemble.select_top(marked, ["s"])
    votes = ensemble.voting(marked, chosen, ["s"]).orderBy("date").collect()
    assert [v.y_pred - v.y_true for v in votes] == pytest.approx([2 / 3, -2 / 3] * 3)
    weighted = ensemble.weighted(marked, chosen, ["s"]).orderBy("date").collect()
    assert [v.y_pred - v.y_true for v in weighted] == pytest.approx([0.4, -0.4] * 3)
    best = ensemble.best_model(ensemble.evaluate(marked, ["s"], stack=False), ["s"]).first()
    assert (best.best_model, best.eval_days) == ("WeightedAverage", 6)
    ranked = ensemble.leaderboard(ensemble.evaluate(marked, ["s"], stack=False), ["s"]).orderBy("rank").collect()
    assert [r.model for r in ranked][:4] == ["WeightedAverage", "Voting", "A", "B"]


def test_stacking_is_ridge_regression(spark, predictions):
    """Two keys of five models each, one of which the second key lacks; gaps, NaN and a key without a complete day."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for key, models in (("a", "VWXYZ"), ("b", "VWYZ"), ("none", "VW")):
        x, y = 1e5 + rng.normal(size=(40, len(models))).cumsum(axis=0), 1e5 + rng.normal(size=40).cumsum()
        x[3, 0], y[5], x[30, 1] = np.nan, np.nan, np.nan
        if key == "none":
            x[:25, 0] = np.nan
        blend = np.arange(40) < 25
        fit = blend & np.isfinite(x).all(axis=1) & np.isfinite(y)
        if fit.any():
            cx = x[fit] - x[fit].mean(axis=0)
            beta = np.linalg.solve(cx.T @ cx + np.eye(len(models)), cx.T @ (y[fit] - y[fit].mean()))
        for i in range(40):
            rows += [(key, i, m, float(y[i]), None if np.isnan(x[i, j]) and i % 2 else float(x[i, j]), bool(blend[i])) for j, m in enumerate(models)]
            if not blend[i]:
                want[key, i] = y[fit].mean() + (x[i] - x[fit].mean(axis=0)) @ beta if fit.any() and np.isfinite(x[i]).all() else None
    df = spark.createDataFrame(rows, "k string, date int, model string, y_true double, y_pred double, is_blend boolean").repartition(5)
    got = {(r.k, r.date): r.y_pred for r in ensemble.stacking(df, ["k"]).collect()}
    assert got.keys() == want.keys() and sum(v is None for v in got.values()) == 17
    assert all(got[k] == (None if v is None else pytest.approx(v, abs=1e-6)) for k, v in want.items())
    plan = ensemble.stacking(df, ["k"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    out = ensemble.stacking(ensemble.split(predictions, ["s"]), ["s"]).collect()
    assert len(out) == 6 and all(np.isfinite(r.y_pred) for r in out)


def test_clusters_are_nearest_and_ranked(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(m, 0.3, (40, 2)) for m in (5, 0, 10)])
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(data, "id int, a double, b double")
    out = cluster.rank_clusters(cluster.kmeans(df, ["a", "b"], 3, 3), "a").toPandas().sort_values("id")
    assert out["cluster"].tolist() == [1] * 40 + [0] * 40 + [2] * 40


def test_pca_is_orthonormal_and_centred(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3)) @ np.diag([5, 2, 0.5]) + 10
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    out, loadings = cluster.pca(df, ["a", "b", "c"])
    np.testing.assert_allclose(loadings.T @ loadings, np.eye(2), atol=1e-9)
    assert (loadings[np.abs(loadings).argmax(0), [0, 1]] > 0).all()
    got = out.orderBy("a").select("pc1", "pc2").toPandas().to_numpy()
    centred = x[np.argsort(x[:, 0])] - x.mean(0)
    np.testing.assert_allclose(got, centred @ loadings, atol=1e-8)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 4))
    y = 4 * x[:, 0] + np.where(x[:, 1] > 0, 3, -3) + 0.1 * rng.normal(size=1500)
    data = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, d double, label double")
    rows = trees.assemble(df, ["a", "b", "c", "d"]).cache()
    return rows, trees.boosting(maxIter=8, maxDepth=3, stepSize=0.3, seed=1).fit(rows)


def test_shap_values_add_up_to_the_prediction(fitted):
    rows, model = fitted
    explained = importance.shap_values(model, model.transform(rows), ["a", "b", "c", "d"])
    total = F.aggregate("shap", F.lit(0.0), lambda s, v: s + v) + F.col("base_value")
    gap = explained.agg(F.max(F.abs(total - F.col("prediction")))).first()[0]
    assert gap < 1e-9
    top = importance.shap_importance(explained, ["a", "b", "c", "d"]).collect()
    assert [r.feature for r in top][:2] == ["a", "b"]
    pairs = importance.shap_dependence(explained, 0)
    assert pairs.stat.corr("value", "shap_value") > 0.9


def test_permutation_finds_the_used_features(fitted):
    rows, model = fitted
    names = ["a", "b", "c", "d"]
    out = {r.feature: r.importance for r in importance.permutation_importance(
        model, rows, ["id"], names, repeats=2, most=600).collect()}
    assert out["a"] > out["b"] > 0.1 and abs(out["c"]) < 0.05
    tree = [r.feature for r in trees.importances(model, names, rows.sparkSession).collect()]
    assert tree[0] == "a"


def test_saved_models_predict_the_same(spark, fitted):
    from pyspark.ml.regression import GBTRegressionModel

    rows, model = fitted
    loaded = read_model(spark, write_model(model, scratch_path(spark, "gbt")), GBTRegressionModel)
    a = model.transform(rows).agg(F.sum("prediction")).first()[0]
    assert loaded.transform(rows).agg(F.sum("prediction")).first()[0] == pytest.approx(a)
    table = trees.node_table(model, spark)
    back = read_model(spark, write_model(table, scratch_path(spark, "nodes")))
    assert back.count() == table.count() > 8
