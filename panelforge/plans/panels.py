"""Row windows, cleaning and daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.binding import Binding
from panelforge.operators import anomaly, cleaning, features, timeseries as ts, windows
from panelforge.operators.aggregates import extremes, group_means, linear_trend
from panelforge.plans.registry import (
    EVENTS, HOLEY, OBS, R, events, holey, observations, query, rounded, table,
)
from panelforge.session import durable, scratch_path
from panelforge.sources import write_parquet

W = "(PARTITION BY user_id ORDER BY ts, event_id)"


def frame(rows: int, last: str = "1 PRECEDING") -> str:
    return f"(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {rows} PRECEDING AND {last})"


@query("wn_lag", "SELECT event_id, " + ", ".join(
    f"lag(value, {k}) OVER {W} AS value_lag{k}" for k in (1, 2, 3, 7, 14)) + " FROM events")
def wn_lag(spark, d):
    out = windows.lags(events(spark, d), EVENTS, ["value"])
    return out.drop("ts", "user_id", "event_type", "value", "props")


def _rolling_sql(column: str = "value") -> str:
    parts = []
    for n in (3, 7, 14, 30):
        f = frame(n)
        guard = f"CASE WHEN count({column}) OVER {f} >= {max(2, n // 2)} THEN"
        parts.append(R(f"{guard} avg({column}) OVER {f} END") + f" AS {column}_rollmean{n}")
        parts.append(R(f"{guard} stddev_samp({column}) OVER {f} END") + f" AS {column}_rollstd{n}")
    return ", ".join(parts)


@query("wn_rolling", f"WITH {HOLEY} SELECT event_id, {_rolling_sql()} FROM holey")
def wn_rolling(spark, d):
    out = windows.rolling(holey(events(spark, d)), EVENTS, ["value"])
    return rounded(out.drop("ts", "user_id", "event_type", "value", "props"))


@query("wn_diff", f"""
SELECT event_id, {R(f'value - lag(value, 1) OVER {W}')} AS change_1,
  {R(f'(value - lag(value, 7) OVER {W}) / 7')} AS trend_7 FROM events""")
def wn_diff(spark, d):
    out = windows.differences(
        events(spark, d), EVENTS, "value", {"change_1": (1, 1.0), "trend_7": (7, 7.0)}
    )
    return rounded(out.select("event_id", "change_1", "trend_7"))


RANGE = frame(6, "CURRENT ROW")


@query("wn_rolling_range", f"""
WITH {HOLEY} SELECT event_id, {R(f'CASE WHEN count(value) OVER {RANGE} >= 3 THEN max(value) OVER {RANGE} - min(value) OVER {RANGE} END')}
  AS range_7 FROM holey""")
def wn_rolling_range(spark, d):
    out = windows.rolling_range(holey(events(spark, d)), EVENTS, "value", "range_7")
    return rounded(out.select("event_id", "range_7"))


@query("wn_label_encode", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment_encoded,
  CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS c_name_encoded FROM customer""")
def wn_label_encode(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    return cleaning.encode_labels(df, ["c_mktsegment", "c_name"]).drop("c_mktsegment", "c_name")


@query("wn_rank_by_metric", f"""
WITH m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1)
SELECT event_type, {R('mean')} AS mean, CAST(row_number() OVER (ORDER BY mean, event_type) AS INTEGER) AS rank FROM m""")
def wn_rank_by_metric(spark, d):
    means = group_means(events(spark, d), ["event_type"], {"mean": "value"})
    return rounded(windows.rank_by(means, [F.asc("mean"), F.asc("event_type")], "rank"))


# One row per calendar day from the first to the last order of each nation.
DAYS = """ends AS (SELECT n_name, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS z FROM obs GROUP BY 1),
spine AS (SELECT n_name, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM ends),
means AS (SELECT n_name, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS price, count(*) AS n_obs FROM obs GROUP BY 1, 2),
daily AS (SELECT s.n_name, s.date, m.price, coalesce(m.n_obs, 0) AS n_obs FROM spine s
  LEFT JOIN means m ON s.n_name = m.n_name AND s.date = m.date)"""

INTERP = """prevs AS (SELECT *, last_value(CASE WHEN price IS NOT NULL THEN date END IGNORE NULLS) OVER b AS pd,
    last_value(price IGNORE NULLS) OVER b AS pv,
    first_value(CASE WHEN price IS NOT NULL THEN date END IGNORE NULLS) OVER f AS nd,
    first_value(price IGNORE NULLS) OVER f AS nv FROM src
  WINDOW b AS (PARTITION BY n_name ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY n_name ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT n_name, date, CASE WHEN price IS NOT NULL THEN price WHEN nd IS NULL THEN pv
    ELSE pv + (nv - pv) * (CAST(date_diff('day', pd, date) AS DOUBLE) / date_diff('day', pd, nd)) END AS price
  FROM prevs WHERE price IS NOT NULL OR pd IS NOT NULL)"""

SERIES = f"WITH {OBS}, {DAYS}, src AS (SELECT * FROM daily), {INTERP}"


def nation_days(spark, d):
    return ts.resample(observations(spark, d), "o_orderdate", {"price": "o_totalprice"}, ["n_name"])


def nation_series(spark, d):
    return ts.daily_frame(
        observations(spark, d), "o_orderdate", {"price": "o_totalprice"}, ["n_name"], coverage=False
    )


@query("ts_daily_gapfill", f"WITH {OBS}, {DAYS} SELECT n_name, date, {R('price')} AS price, n_obs FROM daily")
def ts_daily_gapfill(spark, d):
    return rounded(nation_days(spark, d))


GLOBAL_DAYS = """ends AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS z FROM orders),
spine AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM ends),
means AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS price, count(*) AS n_obs FROM orders GROUP BY 1),
daily AS (SELECT s.date, m.price, coalesce(m.n_obs, 0) AS n_obs FROM spine s LEFT JOIN means m ON s.date = m.date)"""


@query("ts_daily_coverage", f"""
WITH {GLOBAL_DAYS} SELECT date, n_obs, {R('CASE WHEN n_obs >= (SELECT median(n_obs) FROM daily) * 0.5 THEN price END')} AS price
FROM daily""")
def ts_daily_coverage(spark, d):
    daily = ts.resample(table(spark, d, "orders"), "o_orderdate", {"price": "o_totalprice"})
    return rounded(ts.mask_low_coverage(daily, ["price"]))


@query("ts_interpolate", f"""
WITH {OBS}, {DAYS}, med AS (SELECT n_name, median(n_obs) AS m FROM daily GROUP BY 1),
src AS (SELECT daily.n_name, date, CASE WHEN n_obs >= m * 0.5 THEN price END AS price FROM daily JOIN med ON daily.n_name = med.n_name),
{INTERP} SELECT n_name, date, {R('price')} AS price FROM filled""")
def ts_interpolate(spark, d):
    return rounded(ts.daily_frame(
        observations(spark, d), "o_orderdate", {"price": "o_totalprice"}, ["n_name"]
    ))


@query("ts_city_daily", f"{SERIES} SELECT n_name, date, {R('price')} AS price FROM filled")
def ts_city_daily(spark, d):
    return rounded(nation_series(spark, d))


@query("ts_resample", f"""
WITH m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_extendedprice) AS price, count(*) AS n_obs
  FROM lineitem GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS DATE) AS date FROM m)
SELECT s.date, {R('price')} AS price, coalesce(n_obs, 0) AS n_obs FROM s LEFT JOIN m ON s.date = m.date""")
def ts_resample(spark, d):
    return rounded(ts.resample(
        table(spark, d, "lineitem"), "l_shipdate", {"price": "l_extendedprice"}, unit="month"
    ))


CLIM = f"""{SERIES}, clim AS (SELECT n_name, dayofyear(date) AS doy, avg(price) AS m FROM filled GROUP BY 1, 2),
pos AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY doy) AS p, count(*) OVER (PARTITION BY n_name) AS n FROM clim),
wrapped AS (SELECT n_name, doy, m, p AS place, true AS own FROM pos
  UNION ALL SELECT n_name, doy, m, p - n, false FROM pos WHERE p > n - 15
  UNION ALL SELECT n_name, doy, m, p + n, false FROM pos WHERE p <= 15),
base AS (SELECT * FROM (SELECT n_name, doy, own,
    avg(m) OVER (PARTITION BY n_name ORDER BY place ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS baseline FROM wrapped) WHERE own),
anom AS (SELECT f.n_name, f.date, f.price, b.baseline, f.price - b.baseline AS anomaly FROM filled f
  JOIN base b ON f.n_name = b.n_name AND dayofyear(f.date) = b.doy)"""


@query("ts_climatology_anomaly", f"""
{CLIM} SELECT n_name, date, {R('price', 3)} AS price, {R('baseline', 3)} AS baseline, {R('anomaly', 3)} AS anomaly FROM anom""")
def ts_climatology_anomaly(spark, d):
    out = ts.anomalies(nation_series(spark, d), "price", ["n_name"])
    return rounded(out.select("n_name", "date", "price", "baseline", "anomaly"), 3)


@query("ts_anomaly_extremes", f"""
{CLIM} (SELECT 'max' AS kind, date, {R('anomaly', 3)} AS anomaly FROM anom ORDER BY anom.anomaly DESC, date LIMIT 1)
UNION ALL (SELECT 'min', date, {R('anomaly', 3)} FROM anom ORDER BY anom.anomaly, date LIMIT 1)""")
def ts_anomaly_extremes(spark, d):
    return rounded(extremes(ts.anomalies(nation_series(spark, d), "price", ["n_name"]), "anomaly", "date"), 3)


def _supervised_sql() -> str:
    w = "PARTITION BY n_name ORDER BY date"
    parts = [R(f"lag(price, {k}) OVER ({w})") + f" AS lag{k}" for k in ts.LAGS]
    for n in ts.WINDOWS:
        f = f"({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        parts.append(R(f"avg(price) OVER {f}") + f" AS rollmean{n}")
        parts.append(R(f"stddev_pop(price) OVER {f}", 4) + f" AS rollstd{n}")
    parts += [
        "CAST(month(date) AS INTEGER) AS month", "CAST(isodow(date) - 1 AS INTEGER) AS day_of_week",
        R("sin(dayofyear(date) * (2 * pi() / 365.25))") + " AS doy_sin",
        R("cos(dayofyear(date) * (2 * pi() / 365.25))") + " AS doy_cos",
    ]
    return f"""{SERIES} SELECT * EXCLUDE (r) FROM (SELECT n_name, date, {R('price')} AS price, {', '.join(parts)},
  row_number() OVER ({w}) AS r FROM filled) WHERE r > 28"""


@query("ts_supervised", _supervised_sql())
def ts_supervised(spark, d):
    out = ts.supervised(nation_series(spark, d), "price", ["n_name"])
    return rounded(out, **{f"rollstd{n}": 4 for n in ts.WINDOWS})


@query("ts_decompose_classical", f"""
{SERIES}, t AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY date) - 1 AS i,
  CASE WHEN count(price) OVER w = 365 THEN avg(price) OVER w END AS trend FROM filled
  WINDOW w AS (PARTITION BY n_name ORDER BY date ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)),
ph AS (SELECT n_name, i % 365 AS phase, avg(price - trend) AS s FROM t GROUP BY 1, 2),
c AS (SELECT n_name, phase, s - avg(s) OVER (PARTITION BY n_name) AS seasonal FROM ph)
SELECT t.n_name, date, {R("price", 3)} AS price, {R("trend", 3)} AS trend, {R("seasonal", 3)} AS seasonal,
  {R("price - trend - seasonal", 3)} AS resid FROM t JOIN c ON t.n_name = c.n_name AND i % 365 = phase""")
def ts_decompose_classical(spark, d):
    out = ts.classical_decomposition(nation_series(spark, d), "price", 365, ["n_name"])
    return rounded(out.select("n_name", "date", "price", "trend", "seasonal", "resid"), 3)


@query("ts_stl")
def ts_stl(spark, d):
    from panelforge.operators.stl import stl

    return stl(nation_series(spark, d), "price", 365, ["n_name"])


@query("ts_stl_trend")
def ts_stl_trend(spark, d):
    from panelforge.operators.stl import stl

    parts = stl(nation_series(spark, d), "price", 365, ["n_name"])
    return linear_trend(parts, ["n_name"], "trend", F.datediff("date", F.lit("1995-01-01").cast("date")))


@query("wn_train_test_split", f"""
{SERIES} SELECT n_name, date, row_number() OVER (PARTITION BY n_name ORDER BY date DESC) <= 90 AS is_test FROM filled""")
def wn_train_test_split(spark, d):
    return ts.train_test(nation_series(spark, d), 90, ["n_name"]).select("n_name", "date", "is_test")


@query("wn_tail", f"""
{SERIES} SELECT n_name, date, {R('price')} AS price FROM (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY date DESC) AS r
  FROM filled) WHERE r <= 120""")
def wn_tail(spark, d):
    return rounded(ts.tail(nation_series(spark, d), 120, ["n_name"]))


# ---------------------------------------------------------------- cleaning

# Every event twice, then again with a later id: exact copies and copies of (key, ts).
DUPED = """duped AS (SELECT * FROM holey UNION ALL SELECT * FROM holey
  UNION ALL SELECT event_id + 1000000000, ts, user_id, props, value * 2, event_type FROM holey)"""


def duplicated(spark, d):
    df = holey(events(spark, d))
    later = df.withColumns({"event_id": F.col("event_id") + 1_000_000_000, "value": F.col("value") * 2})
    return df.unionByName(df).unionByName(later)


@query("cl_dedupe", f"""
WITH {HOLEY}, {DUPED} SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS r FROM duped)
WHERE r = 1""")
def cl_dedupe(spark, d):
    return cleaning.dedupe(duplicated(spark, d), EVENTS)


MEDIANS = """med AS (SELECT user_id, quantile_cont(value, 0.5) AS m FROM holey GROUP BY 1),
once AS (SELECT h.* REPLACE (coalesce(h.value, med.m) AS value) FROM holey h LEFT JOIN med ON h.user_id = med.user_id),
filled AS (SELECT * REPLACE (coalesce(value, (SELECT quantile_cont(value, 0.5) FROM once)) AS value) FROM once)"""


@query("cl_impute_median", f"WITH {HOLEY}, {MEDIANS} SELECT event_id, {R('value')} AS value FROM filled")
def cl_impute_median(spark, d):
    out = cleaning.impute_median(holey(events(spark, d)), ["user_id"], ["value"])
    return rounded(out.select("event_id", "value"))


MODE = "(SELECT event_type FROM holey WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("cl_impute_mode", f"WITH {HOLEY} SELECT event_id, coalesce(event_type, {MODE}) AS event_type FROM holey")
def cl_impute_mode(spark, d):
    return cleaning.impute_mode(holey(events(spark, d)), ["event_type"]).select("event_id", "event_type")


def _winsor_sql(source: str, column: str, low: float | None = None, high: float | None = None) -> str:
    lo = f"least(q1 - 3 * (q3 - q1), qlo)" if low is None else f"greatest(least(q1 - 3 * (q3 - q1), qlo), {low})"
    hi = f"greatest(q3 + 3 * (q3 - q1), qhi)" if high is None else f"least(greatest(q3 + 3 * (q3 - q1), qhi), {high})"
    return f"""qs AS (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3,
  quantile_cont({column}, 0.001) AS qlo, quantile_cont({column}, 0.999) AS qhi FROM {source}),
fence AS (SELECT CASE WHEN q3 > q1 THEN {lo} END AS lo, CASE WHEN q3 > q1 THEN {hi} END AS hi FROM qs)"""


CAPPED = "CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END"


@query("cl_winsorize", f"WITH {_winsor_sql('events', 'value', 0.0, 250.0)} SELECT event_id, {R(CAPPED)} AS value FROM events, fence")
def cl_winsorize(spark, d):
    out = cleaning.winsorize(events(spark, d), ["value"], hard={"value": (0.0, 250.0)})
    return rounded(out.select("event_id", "value"))


@query("cl_capped_counts", f"""
WITH {_winsor_sql('events', 'value', 0.0, 250.0)} SELECT 'value' AS "column", count(*) FILTER (value < lo OR value > hi) AS capped FROM events, fence""")
def cl_capped_counts(spark, d):
    return cleaning.capped_counts(events(spark, d), ["value"], hard={"value": (0.0, 250.0)})


@query("cl_standardize", f"""
SELECT event_id, {R('(value - avg(value) OVER ()) / stddev_pop(value) OVER ()')} AS value FROM events""")
def cl_standardize(spark, d):
    return rounded(cleaning.standardize(events(spark, d), ["value"]).select("event_id", "value"))


@query("cl_scaling_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {R(f'avg({c})')} AS mean, {R(f'stddev_pop({c})')} AS std FROM lineitem"
    for c in ("l_quantity", "l_discount", "l_tax")))
def cl_scaling_stats(spark, d):
    return rounded(cleaning.scaling_stats(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))


@query("cl_scaled_table", f"""
SELECT {R('(value - avg(value) OVER ()) / stddev_pop(value) OVER ()')} AS value, event_id,
  CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS event_type_encoded FROM events""")
def cl_scaled_table(spark, d):
    return rounded(cleaning.scaled_table(events(spark, d), ["value"], ["event_type"], ["event_id"]))


RULES = {"value": (0.5, 450.0)}
CLEAN = f"""{HOLEY.replace('holey AS', 'raw AS', 1)},
d0 AS (SELECT * FROM raw UNION ALL SELECT * FROM raw
  UNION ALL SELECT event_id + 1000000000, ts, user_id, props, value * 2, event_type FROM raw),
d1 AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS r FROM d0) WHERE r = 1),
holey AS (SELECT * FROM d1 WHERE (value IS NULL OR value BETWEEN 0.5 AND 450) AND ts IS NOT NULL AND user_id IS NOT NULL),
{MEDIANS}, typed AS (SELECT * REPLACE (coalesce(event_type, {MODE}) AS event_type) FROM filled),
{_winsor_sql('typed', 'value', 0.5, 450.0)}"""


@query("cl_clean_panel", f"WITH {CLEAN} SELECT event_id, ts, user_id, event_type, {R(CAPPED)} AS value FROM typed, fence")
def cl_clean_panel(spark, d):
    out = cleaning.clean_panel(
        duplicated(spark, d), EVENTS, ["value"], ["event_type"], ["ts", "user_id"], ["value"],
        rules=RULES, drop=["props"],
    )
    return rounded(out)


@query("cl_report", f"""
WITH {CLEAN} SELECT 'raw' AS step, 'rows' AS item, count(*) AS n FROM d0
UNION ALL SELECT 'deduplicated', 'rows', count(*) FROM d1
UNION ALL SELECT 'in_range', 'rows', count(*) FROM d1 WHERE value IS NULL OR value BETWEEN 0.5 AND 450
UNION ALL SELECT 'clean', 'rows', count(*) FROM holey
UNION ALL SELECT 'violations', 'value', count(*) FILTER (NOT value BETWEEN 0.5 AND 450) FROM d1
UNION ALL SELECT 'violations', 'rows_dropped', count(*) FILTER (NOT value BETWEEN 0.5 AND 450) FROM d1
UNION ALL SELECT 'missing', 'event_id', count(*) FILTER (event_id IS NULL) FROM holey
UNION ALL SELECT 'missing', 'ts', count(*) FILTER (ts IS NULL) FROM holey
UNION ALL SELECT 'missing', 'user_id', count(*) FILTER (user_id IS NULL) FROM holey
UNION ALL SELECT 'missing', 'event_type', count(*) FILTER (event_type IS NULL) FROM holey
UNION ALL SELECT 'missing', 'value', count(*) FILTER (value IS NULL) FROM holey
UNION ALL SELECT 'capped', 'value', count(*) FILTER (value < lo OR value > hi) FROM typed, fence""")
def cl_report(spark, d):
    return cleaning.cleaning_report(
        duplicated(spark, d).drop("props"), EVENTS, ["ts", "user_id"], ["value"], ["value"],
        ["event_type"], rules=RULES,
    )


def _feature_sql() -> str:
    lagged = [R(f"lag(value, {k}) OVER {W}") + f" AS value_lag{k}" for k in (1, 2, 3, 7, 14)]
    return f"""SELECT event_id, {', '.join(lagged)}, {_rolling_sql()},
  {R(f'value - lag(value, 1) OVER {W}')} AS pressure_change_1d, {R(f'(value - lag(value, 7) OVER {W}) / 7')} AS pressure_trend_7d,
  {R(f'CASE WHEN count(value) OVER {RANGE} >= 3 THEN max(value) OVER {RANGE} - min(value) OVER {RANGE} END')} AS temp_range_7d,
  CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(dayofyear(ts) AS INTEGER) AS day_of_year FROM events"""


@query("fe_feature_table", _feature_sql())
def fe_feature_table(spark, d):
    out = features.feature_table(
        events(spark, d), EVENTS, temperature="value", pressure="value", wind="value"
    )
    dropped = ("ts", "user_id", "event_type", "value", "props", "year", "quarter", "month", "week",
               "day", "is_weekend", "wind_category")
    return rounded(out.drop(*dropped))


@query("wn_lag_long_series", "SELECT event_id, lag(value, 2) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS value_lag2 FROM events")
def wn_lag_long_series(spark, d):
    """Few long series: each is cut into blocks of 1,000 rows."""
    b = Binding(("event_type",), "ts", ("event_id",), ("value",))
    return windows.lags(events(spark, d), b, ["value"], [2], block_rows=1000).select("event_id", "value_lag2")


@query("cl_inverse_scaling", f"SELECT event_id, {R('value')} AS value FROM events")
def cl_inverse_scaling(spark, d):
    """Scaled values brought back by the statistics that were kept."""
    rows = events(spark, d)
    stats = durable(cleaning.scaling_stats(rows, ["value"]))
    back = cleaning.unstandardize(cleaning.standardize(rows, ["value"]), stats, ["value"])
    return rounded(back.select("event_id", "value"))


@query("cl_decode_labels", f"WITH {HOLEY} SELECT event_id, coalesce(event_type, 'nan') AS event_type FROM holey")
def cl_decode_labels(spark, d):
    """Encoded labels brought back by their codes."""
    rows = holey(events(spark, d))
    codes = durable(cleaning.label_codes(rows, "event_type"))
    coded = cleaning.encode_labels(rows, ["event_type"]).select("event_id", "event_type_encoded")
    return cleaning.decode_labels(coded, codes, "event_type").select("event_id", "event_type")


@query("cl_prepared_panel", f"""
WITH {CLEAN}, capped AS (SELECT event_id, user_id, event_type, {CAPPED} AS value FROM typed, fence)
SELECT event_id, user_id, {R('(value - avg(value) OVER ()) / stddev_pop(value) OVER ()')} AS value,
  CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS event_type_encoded,
  count(*) OVER () AS total FROM capped""")
def cl_prepared_panel(spark, d):
    """The whole chain: cleaning, outlier flag, scaling, codes, a sorted sink, and the sink read back.

    The flag is random by design and is left out of the comparison; its rows must all be there.
    """
    cleaned = durable(cleaning.clean_panel(
        duplicated(spark, d), EVENTS, ["value"], ["event_type"], ["ts", "user_id"], ["value"],
        rules=RULES, drop=["props"],
    ))
    flagged = anomaly.isolation_forest(cleaned, ["event_id"], ["value"], trees=50)
    scaled = cleaning.scaled_table(flagged, ["value"], ["event_type"], ["event_id", "user_id", "outlier_iforest"])
    path = write_parquet(scaled, scratch_path(spark, "prepared"), sort=["user_id", "event_id"])
    back = spark.read.parquet(path)
    back = back.withColumn("total", back.agg(F.count("outlier_iforest")).scalar())
    return rounded(back.drop("outlier_iforest"))
