"""Anomalies, clusters, forecasts, ensembles and importances."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, functions as F

from panelforge.operators import anomaly, boost, cluster, ensemble, fitted, forecast, forest, importance, trees
from panelforge.operators.aggregates import group_means
from panelforge.operators.sampling import hash_split
from panelforge.plans.panels import SERIES, nation_series
from panelforge.plans.registry import R, events, query, rounded, table
from panelforge.session import durable, side_by_side, spread
from panelforge.sources import scratch_path

KEY = ["n_name"]
# The models of the importances; those of the forecasts stand in forecast.tree_forecast.
TREES = {"trees": 200, "leaf": 3}
BOOSTS = {"rounds": 500, "rate": 0.05, "depth": 6}
LEAVES = {"rounds": 600, "rate": 0.03, "leaves": 31, "least": 20}

# --------------------------------------------------------------------- anomalies


def _event_points(spark, d):
    ev = events(spark, d).withColumn(
        "second", F.hour("ts") * 3600.0 + F.minute("ts") * 60.0 + F.floor(F.second("ts"))
    )
    return anomaly.prepare(ev, ["event_id"], ["value", "second"])


def _noise_sql(points: str, key: str, axes: list[str], eps: float, least: int) -> str:
    near = " AND ".join(
        [f"q.{axes[0]} BETWEEN p.{axes[0]} - {eps * 1.000001} AND p.{axes[0]} + {eps * 1.000001}",
         "(" + " + ".join(f"(p.{a} - q.{a}) * (p.{a} - q.{a})" for a in axes) + f") <= CAST({eps * eps} AS DOUBLE)"]
    )
    return f"""WITH {points}, near AS MATERIALIZED (SELECT p.{key} AS a, q.{key} AS b FROM pts p JOIN pts q ON {near}),
core AS (SELECT a FROM near GROUP BY 1 HAVING count(*) >= {least})
SELECT {key}, {key} NOT IN (SELECT near.a FROM near JOIN core ON near.b = core.a) AS is_noise FROM pts"""


EVENT_POINTS = """raw AS (SELECT event_id, value, hour(ts) * 3600.0 + minute(ts) * 60.0 + second(ts) AS s FROM events),
pts AS (SELECT event_id, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS x,
  (s - avg(s) OVER ()) / stddev_pop(s) OVER () AS y FROM raw)"""


@query("ml_dbscan_noise", _noise_sql(EVENT_POINTS, "event_id", ["x", "y"], 0.1, 10))
def ml_dbscan_noise(spark, d):
    return anomaly.dbscan_noise(
        _event_points(spark, d), ["event_id"], ["value", "second"], eps=0.1, min_samples=10
    )


CUSTOMER_POINTS = """raw AS (SELECT c_custkey, c_acctbal AS b, CAST(count(o_orderkey) AS DOUBLE) AS n, coalesce(avg(o_totalprice), 0) AS p,
  coalesce(max(o_totalprice), 0) AS m FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
pts AS (SELECT c_custkey, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS x, (n - avg(n) OVER ()) / stddev_pop(n) OVER () AS y,
  (p - avg(p) OVER ()) / stddev_pop(p) OVER () AS z, (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS u FROM raw)"""


def _customer_points(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").cast("double").alias("n"), F.avg("o_totalprice").alias("p"),
        F.max("o_totalprice").alias("m"),
    )
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("b")).join(
        per, "c_custkey", "left"
    ).fillna(0.0)
    return anomaly.prepare(rows, ["c_custkey"], ["b", "n", "p", "m"])


@query("ml_dbscan_noise_4d", _noise_sql(CUSTOMER_POINTS, "c_custkey", ["x", "y", "z", "u"], 0.5, 10))
def ml_dbscan_noise_4d(spark, d):
    return anomaly.dbscan_noise(
        _customer_points(spark, d), ["c_custkey"], ["b", "n", "p", "m"], eps=0.5, min_samples=10
    )


CUSTOMER_AXES = ["b", "n", "p", "m", "l", "g"]
CUSTOMER_POINTS_6D = """raw AS (SELECT c_custkey, c_acctbal AS b, CAST(count(o_orderkey) AS DOUBLE) AS n, coalesce(avg(o_totalprice), 0) AS p,
  coalesce(max(o_totalprice), 0) AS m, coalesce(min(o_totalprice), 0) AS l,
  CAST(coalesce(date_diff('day', min(o_orderdate), max(o_orderdate)), 0) AS DOUBLE) AS g
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
pts AS (SELECT c_custkey, """ + ", ".join(f"({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER () AS {x}" for x in CUSTOMER_AXES) + " FROM raw)"


@query("ml_dbscan_noise_6d", _noise_sql(CUSTOMER_POINTS_6D, "c_custkey", CUSTOMER_AXES, 1.2, 10))
def ml_dbscan_noise_6d(spark, d):
    """Customers by six measures, with the distance that is the operator's default."""
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").cast("double").alias("n"), F.avg("o_totalprice").alias("p"),
        F.max("o_totalprice").alias("m"), F.min("o_totalprice").alias("l"),
        F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")).cast("double").alias("g"),
    )
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("b")).join(
        per, "c_custkey", "left"
    ).fillna(0.0)
    return anomaly.dbscan_noise(anomaly.prepare(rows, ["c_custkey"], CUSTOMER_AXES), ["c_custkey"], CUSTOMER_AXES)


@query("ml_prepare", """WITH """ + EVENT_POINTS + f""" SELECT event_id, {R('x')} AS value, {R('y')} AS second FROM pts""")
def ml_prepare(spark, d):
    return rounded(_event_points(spark, d))


@query("ml_isolation_forest")
def ml_isolation_forest(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.xxhash64("*").alias("row_id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    return anomaly.isolation_forest(
        lines, ["row_id"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        partitions=spark.sparkContext.defaultParallelism,
    )


@query("ml_detector_report")
def ml_detector_report(spark, d):
    """Both detectors over the same points: agreement, and what drives each."""
    from panelforge.operators.aggregates import detector_agreement

    points = _customer_points(spark, d)
    names = ["b", "n", "p", "m"]
    a = anomaly.isolation_forest(points, ["c_custkey"], names, trees=200)
    b = anomaly.dbscan_noise(points, ["c_custkey"], names, eps=0.5)
    return detector_agreement(a.join(b, "c_custkey"), "outlier_iforest", "is_noise")


# ---------------------------------------------------------------------- clusters


def _vectors(spark, d, n: int = 64):
    """Embeddings with their elements as columns."""
    return table(spark, d, "embeddings").select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)]
    )


@query("ml_pca2")
def ml_pca2(spark, d):
    names = [f"e{i}" for i in range(64)]
    out, _ = cluster.pca(_vectors(spark, d), names)
    return out.select("vec_id", "label", "pc1", "pc2")


PLACES = {"price": "o_totalprice", "priority": "rank"}


def _places(spark, d):
    orders = table(spark, d, "orders").withColumn("rank", F.substring("o_orderpriority", 1, 1).cast("int"))
    return group_means(orders, ["o_custkey"], PLACES, count="observations")


@query("ml_kmeans")
def ml_kmeans(spark, d):
    names = ["price", "priority", "observations"]
    found = cluster.kmeans(_places(spark, d), names, k=5, starts=10)
    return cluster.rank_clusters(found, "price")


PROFILE = f"""WITH c AS (SELECT o_custkey % 5 AS c, avg(o_totalprice) AS p, count(*) AS n FROM orders GROUP BY o_custkey),
m AS (SELECT c, avg(p) AS price, avg(n) AS orders, count(*) AS n FROM c GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY price, c) - 1 AS INTEGER) AS cluster, {R('price')} AS price, {R('orders')} AS orders, n FROM m"""


@query("ml_cluster_profile", PROFILE)
def ml_cluster_profile(spark, d):
    """Ranking and profile of a fixed assignment."""
    per = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.avg("o_totalprice").alias("price"), F.count("*").alias("orders")
    ).withColumn("cluster", (F.col("o_custkey") % 5).cast("int"))
    ranked = cluster.rank_clusters(per, "price")
    return rounded(cluster.cluster_profile(ranked, {"price": "price", "orders": "orders"}))


# --------------------------------------------------------------------- forecasts

BASE = f"""{SERIES}, b AS (SELECT n_name, date, price,
  lag(price, 1) OVER w AS "Naive", lag(price, 7) OVER w AS "SeasonalNaive7",
  avg(price) OVER (PARTITION BY n_name ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS "Mean7",
  avg(price) OVER (PARTITION BY n_name ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS "Mean30",
  row_number() OVER (PARTITION BY n_name ORDER BY date DESC) AS e FROM filled
  WINDOW w AS (PARTITION BY n_name ORDER BY date)),
preds AS (UNPIVOT (SELECT n_name, date, price AS y_true, "Naive", "SeasonalNaive7", "Mean7", "Mean30" FROM b WHERE e <= 90)
  ON "Naive", "SeasonalNaive7", "Mean7", "Mean30" INTO NAME model VALUE y_pred)"""

METRIC = f"""{R('avg(abs(y_true - y_pred))')} AS mae, {R('sqrt(avg((y_true - y_pred) * (y_true - y_pred)))')} AS rmse,
  {R('avg(abs((y_true - y_pred) / y_true)) FILTER (abs(y_true) > 0.001) * 100')} AS mape,
  {R('CASE WHEN var_pop(y_true) > 0 THEN 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) END')} AS r2,
  count(*) AS n"""


def _baselines(spark, d):
    return forecast.baselines(nation_series(spark, d), "price", KEY)


@query("fc_baselines", f"""
{BASE} SELECT n_name, date, model, {R('y_true')} AS y_true, {R('y_pred')} AS y_pred FROM preds""")
def fc_baselines(spark, d):
    return rounded(_baselines(spark, d).drop("lo", "hi"))


@query("fc_backtest_metrics", f"{BASE} SELECT n_name, model, {METRIC} FROM preds GROUP BY 1, 2")
def fc_backtest_metrics(spark, d):
    return rounded(forecast.backtest_metrics(_baselines(spark, d), KEY, every=False))


@query("fc_arima")
def fc_arima(spark, d):
    return forecast.arima_forecast(nation_series(spark, d), "price", KEY, reason=True)


@query("fc_sarima")
def fc_sarima(spark, d):
    return forecast.sarima_forecast(nation_series(spark, d), "price", KEY, reason=True)


@query("fc_additive")
def fc_additive(spark, d):
    return forecast.additive_forecast(nation_series(spark, d), "price", KEY)


@query("fc_future")
def fc_future(spark, d):
    return forecast.future_outlook(nation_series(spark, d), "price", KEY)


@query("fc_tree")
def fc_tree(spark, d):
    daily = durable(nation_series(spark, d))
    names = ("RandomForest", "GradientBoosting", "LeafBoosting")
    fits = [partial(forecast.tree_forecast, daily, "price", KEY, m) for m in names]
    return reduce(DataFrame.unionByName, side_by_side(fits))


@query("fc_all_models")
def fc_all_models(spark, d):
    """Metrics of every forecaster on every series."""
    daily = durable(nation_series(spark, d))
    predictions = forecast.all_models(daily, "price", KEY, reason=True)
    return forecast.backtest_metrics(predictions, KEY)


# --------------------------------------------------------------------- ensembles

MARKED = f"""{BASE}, ranked AS (SELECT *, dense_rank() OVER (PARTITION BY n_name ORDER BY date) AS dr FROM preds),
marked AS (SELECT *, dr <= floor(max(dr) OVER (PARTITION BY n_name) / 3) AS is_blend FROM ranked),
err AS (SELECT n_name, model, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse FROM marked WHERE is_blend GROUP BY 1, 2),
topm AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY round(rmse, 6), model) AS rank FROM err QUALIFY rank <= 3),
w AS (SELECT *, (1 / rmse) / sum(1 / rmse) OVER (PARTITION BY n_name) AS weight FROM topm),
vote AS (SELECT m.n_name, m.date, any_value(m.y_true) AS y_true, avg(m.y_pred) AS y_pred FROM marked m JOIN w
  ON m.n_name = w.n_name AND m.model = w.model WHERE NOT is_blend GROUP BY 1, 2),
wavg AS (SELECT m.n_name, m.date, any_value(m.y_true) AS y_true, sum(weight * m.y_pred) AS y_pred FROM marked m JOIN w
  ON m.n_name = w.n_name AND m.model = w.model WHERE NOT is_blend GROUP BY 1, 2),
evald AS (SELECT n_name, model, y_true, y_pred FROM marked WHERE NOT is_blend
  UNION ALL SELECT n_name, 'Voting', y_true, y_pred FROM vote
  UNION ALL SELECT n_name, 'WeightedAverage', y_true, y_pred FROM wavg),
scores AS (SELECT n_name, model, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS exact, {METRIC} FROM evald GROUP BY 1, 2)"""


def _marked(spark, d):
    return ensemble.split(_baselines(spark, d), KEY)


@query("wn_blend_eval_split", f"{MARKED} SELECT n_name, date, model, is_blend FROM marked")
def wn_blend_eval_split(spark, d):
    return _marked(spark, d).select("n_name", "date", "model", "is_blend")


@query("en_select_top", f"{MARKED} SELECT n_name, model, {R('rmse')} AS rmse, CAST(rank AS INTEGER) AS rank, {R('weight')} AS weight FROM w")
def en_select_top(spark, d):
    return rounded(ensemble.select_top(_marked(spark, d), KEY))


@query("en_voting", f"{MARKED} SELECT n_name, date, 'Voting' AS model, {R('y_true')} AS y_true, {R('y_pred')} AS y_pred FROM vote")
def en_voting(spark, d):
    marked = _marked(spark, d)
    return rounded(ensemble.voting(marked, ensemble.select_top(marked, KEY), KEY))


@query("en_weighted", f"{MARKED} SELECT n_name, date, 'WeightedAverage' AS model, {R('y_true')} AS y_true, {R('y_pred')} AS y_pred FROM wavg")
def en_weighted(spark, d):
    marked = _marked(spark, d)
    return rounded(ensemble.weighted(marked, ensemble.select_top(marked, KEY), KEY))


def _ridge_sql() -> str:
    """The stacked forecasts: sums of each nation's blend days, and a Cholesky factor entry by entry."""
    names = sorted(["Naive", "SeasonalNaive7", "Mean7", "Mean30"])
    m = range(len(names))
    less = lambda value, pairs: " - ".join([value, *[f"{a} * {b}" for a, b in pairs]])
    ok = " AND ".join(["is_blend", "y_true IS NOT NULL", *[f"x{i} IS NOT NULL" for i in m]])
    entries = []
    for j in m:
        own = less(f"n * g{j}_{j} + 1.0", [(f"l{j}_{k}", f"l{j}_{k}") for k in range(j)])
        entries.append(f"sqrt({own}) AS l{j}_{j}")
        entries += [f"({less(f'n * g{i}_{j}', [(f'l{i}_{k}', f'l{j}_{k}') for k in range(j)])}) / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, len(names))]
    entries += [f"({less(f'n * r{i}', [(f'l{i}_{k}', f'z{k}') for k in range(i)])}) / l{i}_{i} AS z{i}" for i in m]
    entries += [f"({less(f'z{i}', [(f'l{k}_{i}', f'b{k}') for k in range(i + 1, len(names))])}) / l{i}_{i} AS b{i}" for i in reversed(m)]
    return f"""days AS (SELECT n_name, date, any_value(is_blend) AS is_blend, any_value(y_true) AS y_true,
  {", ".join(f"max(y_pred) FILTER (model = '{n}') AS x{i}" for i, n in enumerate(names))} FROM marked GROUP BY 1, 2),
sums AS (SELECT n_name, CAST(count(*) AS DOUBLE) AS n, avg(y_true) AS my, {", ".join(f"avg(x{i}) AS m{i}" for i in m)},
  {", ".join(f"covar_pop(x{i}, x{j}) AS g{i}_{j}" for i in m for j in range(i + 1))},
  {", ".join(f"covar_pop(x{i}, y_true) AS r{i}" for i in m)} FROM days WHERE {ok} GROUP BY 1),
fit AS (SELECT *, {", ".join(entries)} FROM sums),
stack AS (SELECT days.n_name, date, y_true, my {"".join(f" + b{i} * (x{i} - m{i})" for i in m)} AS y_pred
  FROM days LEFT JOIN fit ON days.n_name = fit.n_name WHERE NOT is_blend)"""


STACKED = f"{MARKED}, {_ridge_sql()}"


@query("en_stacking", f"{STACKED} SELECT n_name, date, 'Stacking' AS model, {R('y_true', 3)} AS y_true, {R('y_pred', 3)} AS y_pred FROM stack")
def en_stacking(spark, d):
    return rounded(ensemble.stacking(_marked(spark, d), KEY), 3)


@query("en_model_leaderboard", f"""{MARKED} SELECT n_name, model, mae, rmse, mape, r2, n,
  CAST(row_number() OVER (PARTITION BY n_name ORDER BY round(exact, 6), model) AS INTEGER) AS rank FROM scores""")
def en_model_leaderboard(spark, d):
    metrics = ensemble.evaluate(_marked(spark, d), KEY, stack=False)
    return rounded(ensemble.leaderboard(metrics, KEY))


@query("en_best_model", f"""{MARKED} SELECT n_name, model AS best_model, rmse, n AS eval_days FROM scores
  QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY round(exact, 6), model) = 1""")
def en_best_model(spark, d):
    metrics = ensemble.evaluate(_marked(spark, d), KEY, stack=False)
    return rounded(ensemble.best_model(metrics, KEY))


@query("en_compare_all", f"""{STACKED} SELECT n_name, model, {METRIC.replace(', 6)', ', 3)')} FROM (
  SELECT * FROM evald UNION ALL SELECT n_name, 'Stacking', y_true, y_pred FROM stack) GROUP BY 1, 2""")
def en_compare_all(spark, d):
    """Base models and all three ensembles, stacking included."""
    return rounded(ensemble.evaluate(_marked(spark, d), KEY), 3)


# ------------------------------------------------------------------- importances

PREDICTORS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "ship_month"]


def _supervised_lines(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.xxhash64("*").alias("row_id"), "l_quantity", "l_discount", "l_tax", "l_linenumber",
        F.month("l_shipdate").alias("ship_month"), F.col("l_extendedprice").alias("label"),
    )
    return hash_split(trees.assemble(lines, PREDICTORS), ["row_id"]).select(
        "row_id", "features", "label", "is_train"
    )


def _fitted(spark, d):
    rows = durable(spread(_supervised_lines(spark, d), spark.sparkContext.defaultParallelism))
    train = rows.where("is_train")
    booster = boost.fit(train, len(PREDICTORS), ["row_id"], **BOOSTS)
    return rows, train, booster


def _forest(train):
    return forest.grow(train, len(PREDICTORS), ["row_id"], seed=42, **TREES)


@query("ml_random_forest")
def ml_random_forest(spark, d):
    rows = durable(spread(_supervised_lines(spark, d), spark.sparkContext.defaultParallelism))
    grown = _forest(rows.where("is_train"))
    return forest.predict(grown, rows.where(~F.col("is_train"))).select("row_id", "label", "prediction")


@query("ml_gbt")
def ml_gbt(spark, d):
    rows, _, booster = _fitted(spark, d)
    return booster.transform(rows.where(~F.col("is_train"))).select("row_id", "label", "prediction")


@query("ml_leaf_boosting")
def ml_leaf_boosting(spark, d):
    """Trees grown by leaves, the best first."""
    rows = durable(spread(_supervised_lines(spark, d), spark.sparkContext.defaultParallelism))
    model = boost.fit(rows.where("is_train"), len(PREDICTORS), ["row_id"], **LEAVES)
    return model.transform(rows.where(~F.col("is_train"))).select("row_id", "label", "prediction")


@query("fi_tree")
def fi_tree(spark, d):
    _, train, booster = _fitted(spark, d)
    a = forest.importances(_forest(train), PREDICTORS, 20).withColumn("model", F.lit("random_forest"))
    b = boost.importances(booster, PREDICTORS, spark, 20).withColumn("model", F.lit("boosting"))
    return a.unionByName(b)


@query("fi_permutation")
def fi_permutation(spark, d):
    rows, _, booster = _fitted(spark, d)
    held_out = rows.where(~F.col("is_train"))
    return importance.permutation_importance(booster, held_out, ["row_id"], PREDICTORS)


@query("fi_shap")
def fi_shap(spark, d):
    rows, _, booster = _fitted(spark, d)
    explained = importance.shap_values(booster, rows.where(~F.col("is_train")), PREDICTORS)
    return importance.shap_importance(explained, PREDICTORS)


@query("fi_shap_dependence")
def fi_shap_dependence(spark, d):
    """Value and Shapley value of the strongest feature on every held-out row."""
    rows, _, booster = _fitted(spark, d)
    explained = durable(importance.shap_values(booster, rows.where(~F.col("is_train")), PREDICTORS))
    strongest = importance.shap_importance(explained, PREDICTORS).first()
    if strongest is None:
        return importance.shap_dependence(explained, 0).withColumn("feature", F.lit(PREDICTORS[0]))
    found = importance.shap_dependence(explained, PREDICTORS.index(strongest["feature"]))
    return found.withColumn("feature", F.lit(strongest["feature"]))


LINES = ["l_quantity", "l_extendedprice", "l_discount"]


def _lines(spark, d):
    return table(spark, d, "lineitem").select(
        F.xxhash64("*").alias("row_id"), "l_returnflag", "l_shipdate", *[F.col(c).cast("double").alias(c) for c in LINES]
    )


def _reloaded(spark, stages, rows):
    """A pipeline fitted to ``rows``, saved and loaded again."""
    path = scratch_path(spark, "fitted")
    Pipeline(stages=stages).fit(rows).write().overwrite().save(path)
    return PipelineModel.load(path)


_SCALED = {c: f"(l.{c} - s.m_{c}) / CASE WHEN s.d_{c} > 0 THEN s.d_{c} ELSE 1 END" for c in LINES}


@query("io_fitted_scaling", "WITH s AS (SELECT " + ", ".join(
    f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS d_{c}" for c in LINES
) + " FROM lineitem WHERE l_shipdate < DATE '1996-01-01') SELECT l_returnflag, count(*) AS n, " + ", ".join(
    f"{R(f'avg({x})')} AS mean_{c}, {R(f'min({x})')} AS low_{c}, {R(f'max({x})')} AS high_{c}" for c, x in _SCALED.items()
) + " FROM lineitem l CROSS JOIN s GROUP BY 1")
def io_fitted_scaling(spark, d):
    """All lines by the scaling of the early ones, which was saved and loaded again."""
    rows = _lines(spark, d)
    model = _reloaded(spark, [fitted.Scaling(columns=LINES)], rows.where("l_shipdate < DATE '1996-01-01'"))
    each = [f(c).alias(f"{name}_{c}") for c in LINES for f, name in ((F.avg, "mean"), (F.min, "low"), (F.max, "high"))]
    return rounded(model.transform(rows).groupBy("l_returnflag").agg(F.count("*").alias("n"), *each))


@query("io_fitted_detector")
def io_fitted_detector(spark, d):
    """All lines scored by fences, scaling and an isolation forest of the early ones, which were saved and loaded again."""
    rows = _lines(spark, d)
    stages = [fitted.Fences(columns=LINES), fitted.Scaling(columns=LINES), fitted.IsolationForest(ids=["row_id"], columns=LINES)]
    model = _reloaded(spark, stages, rows.where("l_shipdate < DATE '1996-01-01'"))
    return model.transform(rows).groupBy("l_returnflag", "outlier_iforest").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean_score")
    )


@query("io_model_roundtrip")
def io_model_roundtrip(spark, d):
    """Predictions of a model that was saved and loaded again."""
    rows, _, booster = _fitted(spark, d)
    loaded = boost.Boosted.load(spark, booster.save(spark, scratch_path(spark, "model")))
    return loaded.transform(rows.where(~F.col("is_train"))).agg(
        F.avg("prediction").alias("mean_prediction"), F.count("*").alias("n")
    )
