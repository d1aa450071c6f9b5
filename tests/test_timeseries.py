import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import timeseries as ts
from panelforge.operators.aggregates import linear_trend
from panelforge.operators.stl import Loess, decompose, stl

START = dt.date(2020, 1, 1)


def day(i):
    return START + dt.timedelta(days=i)


def daily(spark, values, series="a"):
    return spark.createDataFrame(
        [(series, day(i), None if v is None else float(v)) for i, v in enumerate(values)],
        "s string, date date, v double",
    )


def series_of(df, column="v"):
    return [r[column] for r in df.orderBy("date").collect()]


def test_resample_shows_empty_days_and_months(rows):
    df = rows("t string, v double", ("2024-01-01 01:00:00", 1.0), ("2024-01-01 05:00:00", 3.0),
              ("2024-01-04 00:00:00", 5.0)).withColumn("t", F.to_timestamp_ntz("t"))
    out = ts.resample(df, "t", {"v": "v"}).orderBy("date").collect()
    assert [(r.date.day, r.v, r.n_obs) for r in out] == [(1, 2.0, 2), (2, None, 0), (3, None, 0), (4, 5.0, 1)]
    wide = rows("t string, v double", ("2023-12-31 00:00:00", 1.0), ("2024-03-02 00:00:00", 3.0)).withColumn(
        "t", F.to_timestamp_ntz("t"))
    out = ts.resample(wide, "t", {"v": "v"}, unit="month").orderBy("date").collect()
    assert [(r.date.month, r.n_obs) for r in out] == [(12, 1), (1, 0), (2, 0), (3, 1)]


def test_coverage_counts_empty_days(rows):
    df = rows("date int, v double, n_obs long", (1, 1.0, 4), (2, 2.0, 1), (3, None, 0), (4, 4.0, 4), (5, 5.0, 2))
    out = {r.date: r.v for r in ts.mask_low_coverage(df, ["v"]).collect()}
    assert out == {1: 1.0, 2: 2.0, 3: None, 4: 4.0, 5: 5.0}  # median 2, limit 1


def test_interpolation_carries_the_end_and_drops_the_start(spark):
    out = ts.interpolate(daily(spark, [None, 1, None, None, 4, None]), ["v"], ["s"])
    assert series_of(out) == pytest.approx([1, 2, 3, 4, 4])
    kept = ts.interpolate(daily(spark, [None, 1]), ["v"], ["s"], drop=False)
    assert series_of(kept) == [None, 1.0]


def circular(means):
    padded = pd.concat([means.tail(15), means, means.head(15)])
    return padded.rolling(31, center=True, min_periods=1).mean().iloc[15:-15]


@pytest.mark.parametrize("days", [20, 800])
def test_climatology_wraps_around_the_year(spark, days):
    y = np.random.default_rng(3).normal(size=days)
    out = ts.anomalies(daily(spark, y), "v", ["s"]).toPandas().sort_values("date")
    frame = pd.Series(y, index=pd.date_range("2020-01-01", periods=days))
    base = circular(frame.groupby(frame.index.dayofyear).mean())
    want = frame - base.loc[frame.index.dayofyear].to_numpy()
    np.testing.assert_allclose(out["anomaly"], want, atol=1e-12)


def test_supervised_rows_see_only_the_past(spark):
    y = np.random.default_rng(4).normal(size=60)
    out = ts.supervised(daily(spark, y), "v", ["s"]).toPandas().sort_values("date", ignore_index=True)
    assert len(out) == 60 - 28
    row = out.iloc[0]
    assert row["lag28"] == y[0] and row["lag1"] == y[27]
    assert row["rollmean30"] == pytest.approx(y[:28].mean())  # only 28 days of history
    assert row["rollstd7"] == pytest.approx(y[21:28].std())
    changed = y.copy()
    changed[40:] += 100
    again = ts.supervised(daily(spark, changed), "v", ["s"]).toPandas().sort_values("date", ignore_index=True)
    names = ts.supervised_features()
    pd.testing.assert_frame_equal(out.loc[:12, names], again.loc[:12, names])


def test_splits_and_tail(spark):
    df = daily(spark, range(10))
    marked = ts.train_test(df, 3, ["s"])
    assert series_of(marked, "is_test") == [False] * 7 + [True] * 3
    assert series_of(ts.tail(df, 2, ["s"])) == [8.0, 9.0]


@pytest.mark.parametrize("period", [4, 5])
def test_classical_parts_add_up(spark, period):
    n = 40
    y = 0.5 * np.arange(n) + np.tile(np.arange(period), n)[:n]
    out = ts.classical_decomposition(daily(spark, y), "v", period, ["s"]).toPandas().sort_values("date")
    half = period // 2
    assert out["trend"].isna().sum() == 2 * half
    np.testing.assert_allclose(out["resid"].dropna(), 0, atol=1e-9)
    phases = out["seasonal"].to_numpy()[:period]
    assert phases.sum() == pytest.approx(0)
    inner = out["trend"].to_numpy()[half:-half]
    np.testing.assert_allclose(np.diff(inner), 0.5, atol=1e-9)


def brute_loess(y, span, weights, ends):
    n, out = len(y), []
    for at in range(-ends, n + ends):
        width = min(span, n)
        start = min(max(at - width // 2, 0), n - width)
        index = np.arange(start, start + width)
        d = index - at
        reach = max(abs(d).max(), 1e-12) + ((span - n) // 2 if span > n else 0)
        k = np.sqrt(np.clip(1 - (abs(d) / reach) ** 3, 0, None) ** 3 * weights[index])
        design = np.stack([np.ones(width), d], axis=1) * k[:, None]
        out.append(np.linalg.lstsq(design, y[index] * k, rcond=None)[0][0])
    return np.array(out)


@pytest.mark.parametrize("n,span,ends", [(50, 11, 0), (6, 7, 1), (7, 7, 1), (9, 7, 1), (40, 41, 0)])
def test_loess_equals_local_least_squares(n, span, ends):
    rng = np.random.default_rng(n)
    y, w = rng.normal(size=n), rng.uniform(0.1, 1, size=n)
    np.testing.assert_allclose(Loess(n, span, ends)(y, w), brute_loess(y, span, w, ends), atol=1e-10)


def test_stl_finds_season_and_ignores_outliers(spark):
    n, period = 240, 12
    t = np.arange(n)
    season = 3 * np.sin(2 * np.pi * t / period)
    y = 0.02 * t + season + np.random.default_rng(5).normal(scale=0.1, size=n)
    y[100] += 40
    trend, found, weight = decompose(y, period)
    assert weight[100] == 0
    assert np.abs(found - season)[20:-20].max() < 0.5 and np.abs(trend - 0.02 * t)[20:-20].max() < 0.3
    both = daily(spark, y).unionByName(daily(spark, y[:20], "short"))
    out = stl(both, "v", period, ["s"]).toPandas()
    assert out[out["s"] == "short"]["trend"].isna().all()
    full = out[out["s"] == "a"].sort_values("date")
    np.testing.assert_allclose(full["trend"], trend)
    np.testing.assert_allclose(full["trend"] + full["seasonal"] + full["resid"], y)


def test_trend_of_a_line(spark):
    fit = linear_trend(daily(spark, 2.0 * np.arange(50)), ["s"], "v", F.datediff("date", F.lit("2020-01-01"))).first()
    assert fit.slope == pytest.approx(2) and fit.slope_per_year == pytest.approx(730.5)
    assert fit.p_value == pytest.approx(0, abs=1e-6) and fit.n == 50
