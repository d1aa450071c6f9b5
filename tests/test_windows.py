import datetime as dt

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from panelforge.binding import Binding
from panelforge.operators import windows
from panelforge.operators.windows import over_series, rolling_columns

B = Binding(("k",), "t", ("i",), ("v",))


@pytest.fixture(scope="module")
def panel(spark):
    """One key holds most rows; gaps, equal timestamps, missing values, keys and times."""
    rng = np.random.default_rng(1)
    n = 900
    keys = np.where(rng.random(n) < 0.7, "hot", np.where(rng.random(n) < 0.5, "b", "c"))
    hours = np.sort(rng.choice(4000, n)) + np.where(np.arange(n) > 600, 90_000, 0)
    pdf = pd.DataFrame({
        "i": np.arange(n), "k": keys, "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, "h"),
        "v": np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n)),
    })
    pdf.loc[[5, 500], "k"] = None
    pdf.loc[[7, 300], "t"] = pd.NaT
    data = [
        (int(r.i), r.k, None if pd.isna(r.t) else r.t.to_pydatetime(), None if pd.isna(r.v) else float(r.v))
        for r in pdf.itertuples()
    ]
    return spark.createDataFrame(data, "i long, k string, t timestamp_ntz, v double").cache()


def pandas_of(df):
    return df.toPandas().sort_values("i", ignore_index=True).drop(columns="t")


def test_long_series_in_blocks_equal_the_plain_window(panel):
    def make(w):
        return rolling_columns(w, ["v"], (3, 7))

    plain = pandas_of(over_series(panel, B, make, 7, block_rows=None))
    for block_rows in (7, 50, 100_000):
        cut = pandas_of(over_series(panel, B, make, 7, block_rows=block_rows))
        assert len(cut) == len(plain) == 900
        pd.testing.assert_frame_equal(cut[plain.columns], plain)


def test_blocks_are_the_default(panel, monkeypatch):
    made = []
    real = windows._blocks
    monkeypatch.setattr(windows, "_blocks", lambda *a: (made.append(a[3]), real(*a))[1])
    windows.lags(panel, B, ["v"], [1])
    assert made == [windows.BLOCK_ROWS]


def test_rolling_equals_pandas_and_keyless_rows_stay(panel):
    got = pandas_of(windows.rolling(panel, B, ["v"], (3, 14)))
    base = panel.toPandas().sort_values(["k", "t", "i"])
    shifted = base.groupby("k")["v"].shift(1)
    for n in (3, 14):
        r = shifted.groupby(base["k"]).rolling(n, min_periods=max(2, n // 2))
        for name, want in (("mean", r.mean()), ("std", r.std())):
            want = want.reset_index(level=0, drop=True)
            want.index = base.loc[want.index, "i"]
            mine = got.dropna(subset=["k"]).set_index("i")[f"v_roll{name}{n}"]
            np.testing.assert_allclose(mine.sort_index(), want.sort_index(), rtol=1e-9, atol=1e-9)
    assert got[got["k"].isna()]["v_rollmean3"].isna().all()


def test_blocks_survive_the_change_of_clocks(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.range(600).selectExpr(
        "id AS i", "'a' AS k", "timestamp_ntz'2024-03-10 00:00:00' + make_dt_interval(0, 0, cast(id AS int)) AS t",
        "cast(id AS double) AS v",
    )
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = windows.lags(df, B, ["v"], [1], block_rows=20).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r.v_lag1 for r in got] == [None, *map(float, range(599))]


@pytest.mark.parametrize("kind", ["int", "date", "timestamp"])
def test_blocks_over_other_kinds_of_time(spark, kind):
    times = {"int": "cast(id AS int)", "date": "date_add(date'2000-01-01', cast(id AS int))",
             "timestamp": "timestamp_seconds(id * 1000)"}
    df = spark.range(300).selectExpr("id AS i", "'a' AS k", f"{times[kind]} AS t", "cast(id AS double) AS v")
    got = windows.lags(df, B, ["v"], [2], block_rows=25).orderBy("i").collect()
    assert [r.v_lag2 for r in got] == [None, None, *map(float, range(298))]


def test_lag_diff_and_range(rows):
    df = rows("k string, t int, v double", *[("a", i, float(i * i)) for i in range(5)], ("b", 0, 1.0))
    b = Binding(("k",), "t")
    out = windows.lags(df, b, ["v"], [1, 3], block_rows=None).where("k = 'a'").orderBy("t").collect()
    assert [r.v_lag1 for r in out] == [None, 0.0, 1.0, 4.0, 9.0]
    assert [r.v_lag3 for r in out] == [None, None, None, 0.0, 1.0]
    out = windows.differences(df, b, "v", {"d": (2, 2.0)}, block_rows=None).where("k = 'a'").orderBy("t").collect()
    assert [r.d for r in out] == [None, None, 2.0, 4.0, 6.0]
    out = windows.rolling_range(df, b, "v", "r", 4, 3, block_rows=None).where("k = 'a'").orderBy("t").collect()
    assert [r.r for r in out] == [None, None, 4.0, 9.0, 15.0]


def test_top_per_group_breaks_ties(rows):
    df = rows("g string, v int, n string", ("a", 1, "y"), ("a", 1, "x"), ("a", 0, "z"), ("b", 5, "q"))
    from pyspark.sql import functions as F

    out = windows.top_per_group(df, ["g"], [F.desc("v"), F.asc("n")], 1).collect()
    assert sorted((r.g, r.n) for r in out) == [("a", "x"), ("b", "q")]


def test_a_burst_and_a_single_time_are_spread(spark):
    """One row in 1970 and all others in one second: no range holds much more than its share, and numbers go on."""
    late = dt.datetime(2024, 5, 1, 12, 0, 0)
    data = [("s", dt.datetime(1970, 1, 1), 0, 0.0)] + [("s", late, i, float(i % 97)) for i in range(1, 20_000)]
    df = spark.createDataFrame(data, "k string, ts timestamp, id long, v double").repartition(5)
    b = Binding(key=("k",), ts="ts", tiebreak=("id",), values=("v",))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = df.repartitionByRange("k", *b.order()).groupBy(F.spark_partition_id()).count().collect()
        assert len(ranged) >= 4 and max(r["count"] for r in ranged) < 8_000
        got = windows.lags(df, b, ["v"], (1, 5), block_rows=700)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = windows.lags(df, b, ["v"], (1, 5), block_rows=None)
    key = lambda d: sorted(tuple(r) for r in d.select("id", F.coalesce("v_lag1", F.lit(-1.0)), F.coalesce("v_lag5", F.lit(-1.0))).collect())
    assert key(got) == key(want)
    assert sorted(r._pos for r in windows._numbered(df, b).select("_pos").collect()) == list(range(20_000))
