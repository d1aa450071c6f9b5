import math

import pytest
from pyspark.sql import functions as F

from panelforge.binding import col
from panelforge.functions import (
    bin_label, calendar_columns, capped, line_p_value, nan_to_null, parse_ts, prefix_group,
    width_bin,
)
from panelforge.operators import features, filters


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_bins_are_open_below_and_closed_above(rows):
    df = rows("v double", *[(v,) for v in (-1.0, 0.0, 12.0, 12.1, 1000.0, 1001.0, None)])
    got = [r[0] for r in df.select(features.wind_class(F.col("v"))).collect()]
    assert got == ["nan", "Calm", "Calm", "Light", "Storm", "nan", "nan"]
    open_low = bin_label(F.col("v"), [0, 12, 29], ["a", "b"])
    assert [r[0] for r in df.select(open_low).collect()][:3] == [None, None, "a"]
    with pytest.raises(ValueError):
        bin_label(F.col("v"), [0, 1, 2], ["only one"])


def test_calendar_follows_iso_weeks_and_hemispheres(rows):
    df = rows("t string, lat double", ("2024-12-30", 0.0), ("2024-02-29", -0.1), ("2024-09-01", 10.0))
    ts = parse_ts(F.col("t"))
    out = df.select(*[c.alias(n) for n, c in calendar_columns(ts, F.col("lat")).items()])
    got = values(out, "week", "day_of_week", "day_of_year", "is_weekend", "season")
    assert got == [(1, 0, 365, 0, "Winter"), (9, 3, 60, 0, "Summer"), (35, 6, 245, 1, "Autumn")]


def test_bad_timestamps_become_null(rows):
    df = rows("t string", ("2024-01-02 03:04:05",), ("yesterday",), (None,))
    got = [r[0] for r in df.select(parse_ts(F.col("t"))).collect()]
    assert got[0].hour == 3 and got[1:] == [None, None]


def test_prefix_groups(rows):
    names = ("Asia/Tokyo", "US/Central", "Arctic/X", "UTC", "Mars/Base", None)
    df = rows("tz string", *[(n,) for n in names])
    got = [r[0] for r in df.select(prefix_group(F.col("tz"))).collect()]
    assert got == ["Asia", "Americas", "Europe", "Other", "Other", "Other"]


def test_dotted_names_and_nan(rows):
    df = nan_to_null(rows("`pm2.5` double, `us-index` int", (float("nan"), 1), (2.0, 2)))
    assert df.agg(F.avg(col("pm2.5"))).first()[0] == 2.0


def test_range_filter_keeps_bounds_and_missing(rows):
    df = rows("id int, humidity double", (1, 0.0), (2, 100.0), (3, 100.1), (4, -0.1), (5, None))
    assert sorted(r.id for r in filters.keep_in_range(df).collect()) == [1, 2, 5]
    counts = {r.rule: r.violations for r in filters.rule_violations(df).collect()}
    assert counts == {"humidity": 2, "rows_dropped": 2}


def test_filter_set_all_is_no_filter_and_end_day_is_included(rows):
    df = rows("c string, t string", ("a", "2024-01-01 23:59:59"), ("b", "2024-01-02 00:00:00")).withColumn(
        "t", parse_ts(F.col("t"))
    )
    assert filters.filter_set(df, "t", {"c": "All"}, end="2024-01-01").count() == 1
    assert filters.filter_set(df, "t", {"c": "b"}, start="2024-01-01", end="2024-01-02").count() == 1


def test_predictors_leave_out_flags_text_and_leaks(rows):
    df = rows(
        "humidity double, month int, country string, outlier_iforest boolean, temperature_celsius double",
        (1.0, 1, "x", False, 5.0), (2.0, None, "x", False, 5.0), (3.0, 3, "x", True, 5.0),
    )
    out = filters.predictor_rows(df, "temperature_celsius")
    assert out.columns == ["humidity", "month", "temperature_celsius"] and out.count() == 1


def test_last_histogram_bin_is_closed_and_caps_keep_null(rows):
    df = rows("v double", (0.0,), (9.99,), (10.0,), (None,))
    got = [r[0] for r in df.select(width_bin(F.col("v"), F.lit(0.0), F.lit(10.0), 5)).collect()]
    assert got == [0, 4, 4, None]
    got = [r[0] for r in df.select(capped(F.col("v"), F.lit(1.0), F.lit(5.0))).collect()]
    assert got == [1.0, 5.0, 5.0, None]


def test_p_value_of_many_rows_is_a_normal_tail(rows):
    n = 10**7
    df = rows("t double", *[(t / 4,) for t in range(-12, 13)])
    r2 = F.col("t") ** 2 / (n - 2 + F.col("t") ** 2)
    for t, p in values(df.select("t", line_p_value(r2, F.lit(n)).alias("p")), "t", "p"):
        assert abs(p - math.erfc(abs(t) / math.sqrt(2))) < 1e-6
