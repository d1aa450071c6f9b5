"""Forecasts of many series at once, judged on the last days of each.

All forecasters return the same long table: the series columns, ``date``,
``model``, ``y_true``, ``y_pred``, ``lo`` and ``hi``. Predictions are one step
ahead: each uses the true values up to the day before, and the fits see only
the days before the test window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from panelforge.binding import col
from panelforge.functions.stats import regression_metric_columns
from panelforge.operators import additive, arima, boost, forest
from panelforge.operators.aggregates import grouped, regression_metrics
from panelforge.operators.timeseries import LAGS, from_end, supervised, supervised_features
from panelforge.operators.trees import assemble
from panelforge.session import by_group, durable, side_by_side

TEST_DAYS, HORIZON = 90, 30


def _columns(daily: DataFrame, series: Sequence[str]) -> str:
    kinds = dict(daily.dtypes)
    return ", ".join([f"`{s}` {kinds[s]}" for s in series])


def baselines(
    daily: DataFrame, value: str, series: Sequence[str], test: int = TEST_DAYS, date: str = "date"
) -> DataFrame:
    """Last value, value a week ago, and means of the last 7 and 30 days."""
    w = Window.partitionBy(*[col(s) for s in series]).orderBy(date)
    v = col(value)
    models = {
        "Naive": F.lag(v, 1).over(w),
        "SeasonalNaive7": F.lag(v, 7).over(w),
        "Mean7": F.avg(v).over(w.rowsBetween(-7, -1)),
        "Mean30": F.avg(v).over(w.rowsBetween(-30, -1)),
    }
    rows = from_end(daily.withColumns(models), series, date, "_e").where(F.col("_e") <= test)
    keys = [*[col(s) for s in series], F.col(date), v.alias("y_true")]
    none = F.lit(None).cast("double")
    return rows.select(*keys, *models).unpivot(
        [*[col(s) for s in series], F.col(date), F.col("y_true")], list(models), "model", "y_pred"
    ).withColumns({"lo": none, "hi": none})


def _per_series(
    daily: DataFrame, value: str, series: Sequence[str], test: int, date: str, model: str,
    predict: Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]],
    needed: int, reason: bool,
) -> DataFrame:
    """Run ``predict(days, values, test)`` on each series in its own task.

    The test days are those of the baselines. A series with fewer than
    ``needed`` days before them gets NULL predictions.
    """
    keys = list(series)
    schema = (f"{_columns(daily, keys)}, `{date}` date, model string, y_true double, y_pred double, "
              "lo double, hi double, reason string")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        y = pdf[value].to_numpy(float)
        days = pd.to_datetime(pdf[date]).to_numpy().astype("datetime64[D]").astype(float)
        size = min(test, len(y))
        train = len(y) - size
        out = pdf[[*keys, date]].iloc[train:].copy()
        if train < needed:
            predicted = width = np.full(size, np.nan)
        else:
            predicted, width = predict(days, y, size)
        return out.assign(
            model=model, y_true=y[train:], y_pred=predicted,
            lo=predicted - width, hi=predicted + width,
            reason=f"{train} days before the test window, {needed} needed" if train < needed else None,
        )

    rows = daily.select(*[col(k) for k in keys], col(date), col(value).cast("double").alias(value))
    out = by_group(rows, keys).groupBy(*[col(k) for k in keys]).applyInPandas(run, schema)
    return out if reason else out.drop("reason")


def arima_forecast(
    daily: DataFrame, value: str, series: Sequence[str], test: int = TEST_DAYS,
    order: arima.Order = (2, 1, 2), date: str = "date", reason: bool = False,
) -> DataFrame:
    """``reason`` adds a column that says why predictions are NULL; so in the other forecasters."""
    return _per_series(
        daily, value, series, test, date, "ARIMA",
        lambda _, y, n: arima.backtest(y, n, order), arima.days_needed(order), reason,
    )


def sarima_forecast(
    daily: DataFrame, value: str, series: Sequence[str], test: int = TEST_DAYS,
    order: arima.Order = (1, 1, 1), seasonal: arima.Order = (1, 1, 1), period: int = 7,
    date: str = "date", reason: bool = False,
) -> DataFrame:
    return _per_series(
        daily, value, series, test, date, "SARIMA",
        lambda _, y, n: arima.backtest(y, n, order, seasonal, period),
        arima.days_needed(order, seasonal, period), reason,
    )


def additive_forecast(
    daily: DataFrame, value: str, series: Sequence[str], test: int = TEST_DAYS, date: str = "date",
    reason: bool = False,
) -> DataFrame:
    """Additive curve fitted before the test window and drawn through it."""

    def predict(days, y, n):
        split = len(y) - n
        return additive.fit_predict(days[:split], y[:split], days[split:])

    return _per_series(daily, value, series, test, date, "Additive", predict, 1, reason)


def future_outlook(
    daily: DataFrame, value: str, series: Sequence[str], horizon: int = HORIZON, date: str = "date"
) -> DataFrame:
    """Additive curve over all days and ``horizon`` more: ``(series..., ds, yhat, yhat_lower, yhat_upper)``."""
    keys = list(series)
    schema = f"{_columns(daily, keys)}, ds date, yhat double, yhat_lower double, yhat_upper double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        days = pd.to_datetime(pdf[date]).to_numpy().astype("datetime64[D]").astype(float)
        at = np.concatenate((days, days[-1] + np.arange(1, horizon + 1)))
        curve, width = additive.fit_predict(days, pdf[value].to_numpy(float), at)
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * len(at) for k in keys})
        return out.assign(
            ds=at.astype("datetime64[D]").astype("datetime64[s]"), yhat=curve,
            yhat_lower=curve - width, yhat_upper=curve + width,
        ).assign(ds=lambda f: pd.to_datetime(f["ds"]).dt.date)

    rows = daily.select(*[col(k) for k in keys], col(date), col(value).cast("double").alias(value))
    return by_group(rows, keys).groupBy(*[col(k) for k in keys]).applyInPandas(run, schema)


def tree_forecast(
    daily: DataFrame, value: str, series: Sequence[str], model: str, test: int = TEST_DAYS,
    date: str = "date", seed: int = 42, reason: bool = False, **params,
) -> DataFrame:
    """One tree ensemble pooled over all series, on features of earlier days only.

    ``model`` is RandomForest, GradientBoosting (by levels, depth 4) or
    LeafBoosting (by leaves, 31). Test days without all lags get NULL predictions.
    """
    ranked = from_end(daily, series, date, "_e")
    rows = supervised(ranked, value, series, date)
    features = supervised_features()
    rows = assemble(rows, features).withColumn("label", col(value).cast("double"))
    rows = rows.select(*[col(s) for s in series], date, "_e", "features", "label")
    rows = durable(by_group(rows, series))
    train = rows.where(F.col("_e") > test).select("features", "label")
    keys = [*[col(s) for s in series], F.col(date), F.lit(model).alias("model")]
    none = F.lit(None).cast("double")
    missing = [none.alias(n) for n in ("y_pred", "lo", "hi")]
    since = F.row_number().over(Window.partitionBy(*[col(s) for s in series]).orderBy(date))
    early = ranked.withColumn("_r", since).where((F.col("_r") <= max(LAGS)) & (F.col("_e") <= test))
    early = early.select(
        *keys, col(value).cast("double").alias("y_true"), *missing,
        F.concat((F.col("_r") - 1).cast("string"), F.lit(f" days before, {max(LAGS)} needed")).alias("reason"),
    )
    if train.isEmpty():
        nothing = rows.where(F.col("_e") <= test).select(
            *keys, F.col("label").alias("y_true"), *missing, F.lit("no day to fit on in any series").alias("reason")
        )
        return early.unionByName(nothing) if reason else early.unionByName(nothing).drop("reason")
    held_out = rows.where(F.col("_e") <= test)
    if model == "RandomForest":
        fitted = forest.grow(
            rows.where(F.col("_e") > test), len(features), [*series, date],
            **{"trees": 400, "leaf": 2, "seed": seed, **params},
        )
        scored = forest.predict(fitted, held_out)
    else:
        shape = {"leaves": 31, "least": 20} if model == "LeafBoosting" else {"depth": 4}
        fitted = boost.fit(
            rows.where(F.col("_e") > test), len(features), [*series, date],
            **{"rounds": 600, "rate": 0.03, "seed": seed, **shape, **params},
        )
        scored = fitted.transform(held_out)
    scored = scored.select(
        *keys, F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"),
        none.alias("lo"), none.alias("hi"), F.lit(None).cast("string").alias("reason"),
    )
    return scored.unionByName(early) if reason else scored.unionByName(early).drop("reason")


def all_models(
    daily: DataFrame, value: str, series: Sequence[str], test: int = TEST_DAYS,
    trees: dict[str, dict] | None = None, reason: bool = False,
) -> DataFrame:
    """Predictions of every forecaster in one table; ``trees`` sets parameters by model name."""
    names = ("RandomForest", "GradientBoosting", "LeafBoosting")
    trees = {n: {} for n in names} if trees is None else trees
    parts = [
        *[f(daily, value, series, test, reason=reason) for f in (arima_forecast, sarima_forecast, additive_forecast)],
        *side_by_side(
            [partial(tree_forecast, daily, value, series, n, test, reason=reason, **p) for n, p in trees.items()]
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def backtest_metrics(predictions: DataFrame, keys: Sequence[str], every: bool = True) -> DataFrame:
    """MAE, RMSE, MAPE and R2 per key and model.

    With ``every``, a model without predictions for a key has a row of n = 0
    and no metrics; a column ``reason`` of the predictions is kept.
    """
    names = [*keys, "model"]
    if not every:
        return regression_metrics(predictions, names)
    why = [F.max("reason").alias("reason")] if "reason" in predictions.columns else []
    # One aggregation: rows without both sides stay in their group but count in no metric.
    both = col("y_true").isNotNull() & col("y_pred").isNotNull()
    actual, predicted = F.when(both, col("y_true")), F.when(both, col("y_pred"))
    made = regression_metric_columns(actual, predicted)
    return grouped(predictions, names).agg(
        *[m.alias(n) for n, m in made.items()], F.count(predicted).alias("n"), *why
    )
