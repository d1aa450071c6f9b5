"""Aggregates, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.binding import col
from panelforge.functions import bin_interval, code_labels, prefix_group
from panelforge.functions.lookup import EPA_LEVELS
from panelforge.operators import aggregates as agg
from panelforge.operators import features, joins, sampling, windows
from panelforge.operators.quantiles import quantile_table
from panelforge.plans.registry import (
    HOLEY, OBS, ORDERS, R, events, holey, observations, query, rounded, table,
)

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("agg_kpis", f"""
WITH {OBS} SELECT count(*) AS n_rows, count(DISTINCT n_name) AS n_countries,
  count(DISTINCT o_custkey) AS n_cities, {R('avg(o_totalprice)')} AS mean_price,
  {R('avg(c_acctbal)')} AS mean_balance FROM obs""")
def agg_kpis(spark, d):
    return rounded(agg.kpis(
        observations(spark, d), {"n_countries": "n_name", "n_cities": "o_custkey"},
        {"mean_price": "o_totalprice", "mean_balance": "c_acctbal"},
    ))


@query("agg_mean_by_key", f"""
WITH {OBS} SELECT CAST(month(o_orderdate) AS INTEGER) AS month, {R('avg(o_totalprice)')} AS price,
  {R('avg(c_acctbal)')} AS balance FROM obs GROUP BY 1""")
def agg_mean_by_key(spark, d):
    df = observations(spark, d).withColumn("month", F.month("o_orderdate"))
    return rounded(agg.group_means(df, ["month"], {"price": "o_totalprice", "balance": "c_acctbal"}))


@query("agg_mean_by_two_keys", f"""
WITH {OBS} SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, r_name,
  {R('avg(o_totalprice)')} AS price FROM obs GROUP BY 1, 2""")
def agg_mean_by_two_keys(spark, d):
    df = observations(spark, d).withColumn("period", F.to_date(F.date_trunc("month", "o_orderdate")))
    return rounded(agg.group_means(df, ["period", "r_name"], {"price": "o_totalprice"}))


@query("agg_reindex", f"""
WITH {OBS}, spine(position, r_name) AS (VALUES (0, 'ASIA'), (1, 'AFRICA'), (2, 'ATLANTIS'), (3, 'EUROPE')),
m AS (SELECT r_name, avg(o_totalprice) AS price FROM obs GROUP BY 1)
SELECT CAST(position AS INTEGER) AS position, spine.r_name, {R('price')} AS price
FROM spine LEFT JOIN m ON spine.r_name = m.r_name""")
def agg_reindex(spark, d):
    means = agg.group_means(observations(spark, d), ["r_name"], {"price": "o_totalprice"})
    return rounded(agg.reindex(means, "r_name", ["ASIA", "AFRICA", "ATLANTIS", "EUROPE"]))


@query("agg_mean_of_means", f"""
WITH common AS (SELECT month(o_orderdate) AS m FROM orders GROUP BY 1
  HAVING count(DISTINCT year(o_orderdate)) = (SELECT count(DISTINCT year(o_orderdate)) FROM orders)),
monthly AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, avg(o_totalprice) AS p
  FROM orders WHERE month(o_orderdate) IN (SELECT m FROM common) GROUP BY 1, 2)
SELECT CAST(y AS INTEGER) AS year, {R('avg(p)')} AS price FROM monthly GROUP BY 1""")
def agg_mean_of_means(spark, d):
    df = table(spark, d, "orders").select(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        F.col("o_totalprice").alias("price"),
    )
    balanced = joins.keep_listed(df, agg.common_values(df, "month", "year"), "month")
    return rounded(agg.mean_of_means(balanced, "year", "month", {"price": "price"}))


@query("agg_common_months", """
SELECT CAST(month(o_orderdate) AS INTEGER) AS month FROM orders GROUP BY 1
HAVING count(DISTINCT year(o_orderdate)) = (SELECT count(DISTINCT year(o_orderdate)) FROM orders)""")
def agg_common_months(spark, d):
    df = table(spark, d, "orders").select(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    )
    return agg.common_values(df, "month", "year")


@query("agg_category_share", f"""
WITH spine(position, category, code) AS (VALUES (0, 'Good', 1), (1, 'Moderate', 2),
  (2, 'Unhealthy (sensitive)', 3), (3, 'Unhealthy', 4), (4, 'Very unhealthy', 5), (5, 'Hazardous', 6)),
c AS (SELECT l_linenumber AS code, count(*) AS n FROM lineitem GROUP BY 1),
f AS (SELECT position, category, coalesce(n, 0) AS n FROM spine LEFT JOIN c USING (code))
SELECT CAST(position AS INTEGER) AS position, category, {R('n / sum(n) OVER () * 100.0')} AS share_pct FROM f""")
def agg_category_share(spark, d):
    label = code_labels(F.col("l_linenumber"))
    return rounded(agg.category_share(
        table(spark, d, "lineitem"), label, list(EPA_LEVELS.values())
    ))


@query("agg_value_counts_topk", f"""
WITH {HOLEY} SELECT event_type, count(*) AS n FROM holey WHERE event_type IS NOT NULL
GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3""")
def agg_value_counts_topk(spark, d):
    padded = holey(events(spark, d)).withColumn(
        "event_type", F.concat(F.col("event_type"), F.lit("  "))
    )
    return agg.top_values(padded, "event_type", 3)


@query("agg_location_summary", f"""
WITH {OBS} SELECT o_custkey, arg_min(o_orderpriority, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS priority,
  {R('quantile_cont(latitude, 0.5)')} AS latitude, {R('quantile_cont(o_totalprice, 0.5)')} AS median_price,
  {R('avg(o_totalprice)')} AS price, {R('avg(c_acctbal)')} AS balance, count(*) AS observations
FROM obs GROUP BY 1 HAVING count(*) >= 10""")
def agg_location_summary(spark, d):
    return rounded(agg.group_summary(
        observations(spark, d), ORDERS, "o_custkey",
        means={"price": "o_totalprice", "balance": "c_acctbal"}, least=10,
        first={"priority": "o_orderpriority"},
        medians={"latitude": "latitude", "median_price": "o_totalprice"},
    ))


@query("agg_country_summary", f"""
WITH {OBS} SELECT n_name, {R('avg(o_totalprice)')} AS price, {R('avg(c_acctbal)')} AS balance,
  {R('avg(latitude)')} AS latitude, count(*) AS observations
FROM obs GROUP BY 1 HAVING count(*) >= 100""")
def agg_country_summary(spark, d):
    return rounded(agg.group_means(
        observations(spark, d), ["n_name"],
        {"price": "o_totalprice", "balance": "c_acctbal", "latitude": "latitude"},
        count="observations", least=100,
    ))


@query("agg_city_ranking", f"""
SELECT user_id, {R('avg(value)')} AS mean, count(*) AS n FROM events
GROUP BY 1 HAVING count(*) >= 50 ORDER BY avg(value) DESC, user_id LIMIT 15""")
def agg_city_ranking(spark, d):
    return rounded(agg.ranking(events(spark, d), "user_id", "value", 15, least=50))


@query("agg_median_by_key", f"""
SELECT l_suppkey, {R('quantile_cont(l_extendedprice, 0.5)')} AS median_price,
  {R('quantile_cont(l_discount, 0.5)')} AS median_discount FROM lineitem GROUP BY 1""")
def agg_median_by_key(spark, d):
    return rounded(quantile_table(
        table(spark, d, "lineitem"), ["l_suppkey"],
        {"median_price": (F.col("l_extendedprice"), 0.5),
         "median_discount": (F.col("l_discount"), 0.5)},
    ))


def _describe_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS n, {R(f'avg({c})', 4)} AS mean,
  {R(f'stddev_samp({c})', 4)} AS std, {R(f'min({c})', 4)} AS min, {R(f'quantile_cont({c}, 0.25)', 4)} AS q25,
  {R(f'quantile_cont({c}, 0.5)', 4)} AS q50, {R(f'quantile_cont({c}, 0.75)', 4)} AS q75,
  {R(f'max({c})', 4)} AS max FROM lineitem"""


@query("agg_describe", " UNION ALL ".join(_describe_sql(c) for c in LINE))
def agg_describe(spark, d):
    return rounded(agg.describe(table(spark, d, "lineitem"), LINE), 4)


@query("agg_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS measure, CAST({p} AS DOUBLE) AS prob, {R(f'quantile_cont({c}, {p})')} AS quantile FROM lineitem"
    for c in LINE for p in (0.001, 0.25, 0.75, 0.95, 0.999)))
def agg_quantiles(spark, d):
    from panelforge.operators.quantiles import exact_quantiles

    out = exact_quantiles(
        table(spark, d, "lineitem"), [], {c: F.col(c) for c in LINE},
        [0.001, 0.25, 0.75, 0.95, 0.999],
    )
    return out.withColumn("quantile", F.round(F.col("quantile") + F.lit(3e-8), 6) + F.lit(0.0))


@query("agg_mode", f"""
WITH {HOLEY}, c AS (
  SELECT 'event_type' AS "column", event_type AS v, count(*) AS n FROM holey WHERE event_type IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*) FROM holey GROUP BY ALL)
SELECT "column", v AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) = 1""")
def agg_mode(spark, d):
    return agg.mode_per_column(holey(events(spark, d)), ["event_type", "user_id"])


@query("agg_null_counts", f"""
WITH {HOLEY} SELECT 'event_id' AS "column", count(*) FILTER (event_id IS NULL) AS missing FROM holey
UNION ALL SELECT 'ts', count(*) FILTER (ts IS NULL) FROM holey
UNION ALL SELECT 'user_id', count(*) FILTER (user_id IS NULL) FROM holey
UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL) FROM holey
UNION ALL SELECT 'value', count(*) FILTER (value IS NULL) FROM holey
UNION ALL SELECT 'props', count(*) FILTER (props IS NULL) FROM holey""")
def agg_null_counts(spark, d):
    return agg.null_counts(holey(events(spark, d)))


def _corr_sql(pairs) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS \"row\", '{b}' AS \"column\", {R(f'corr({a}, {b})')} AS r FROM lineitem"
        for a, b in pairs
    )


@query("agg_corr_matrix", _corr_sql([(a, b) for a in LINE for b in LINE]))
def agg_corr_matrix(spark, d):
    return rounded(agg.correlations(table(spark, d, "lineitem"), LINE))


@query("agg_corr_block", _corr_sql([(a, b) for a in LINE[:2] for b in LINE[2:]]))
def agg_corr_block(spark, d):
    return rounded(agg.correlations(table(spark, d, "lineitem"), LINE[:2], LINE[2:]))


@query("agg_histogram", f"""
WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT CAST(least(floor((value - lo) / (hi - lo) * 60), 59) AS INTEGER) AS bin, count(*) AS n
  FROM events, e GROUP BY 1)
SELECT CAST(s.i AS INTEGER) AS bin, {R('lo + i * ((hi - lo) / 60)')} AS left_edge,
  {R('lo + (i + 1) * ((hi - lo) / 60)')} AS right_edge, coalesce(n, 0) AS n
FROM range(60) s(i) CROSS JOIN e LEFT JOIN b ON b.bin = s.i""")
def agg_histogram(spark, d):
    return rounded(agg.histogram(events(spark, d), "value", 60))


@query("agg_box_stats", f"""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, {R('q1')} AS q1, {R('median')} AS median, {R('q3')} AS q3,
  {R('min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_low,
  {R('max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_high,
  count(value) AS n FROM events JOIN q USING (event_type) GROUP BY event_type, q1, median, q3""")
def agg_box_stats(spark, d):
    return rounded(agg.box_stats(events(spark, d), "event_type", "value"))


@query("agg_binned_mean", f"""
SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 5 THEN '(0, 5]' WHEN l_quantity > 5 AND l_quantity <= 10 THEN '(5, 10]'
  WHEN l_quantity > 10 AND l_quantity <= 15 THEN '(10, 15]' WHEN l_quantity > 15 AND l_quantity <= 20 THEN '(15, 20]'
  WHEN l_quantity > 20 AND l_quantity <= 30 THEN '(20, 30]' END AS band,
  {R('avg(l_extendedprice)')} AS mean, count(*) AS n FROM lineitem WHERE l_quantity > 0 AND l_quantity <= 30 GROUP BY 1""")
def agg_binned_mean(spark, d):
    band = bin_interval(F.col("l_quantity"), [0, 5, 10, 15, 20, 30])
    return rounded(agg.binned_means(table(spark, d, "lineitem"), band, "l_extendedprice"))


@query("agg_pivot", f"""
WITH {OBS} SELECT CAST(month(o_orderdate) AS INTEGER) AS month,
  {R("avg(o_totalprice) FILTER (r_name = 'ASIA')")} AS "ASIA",
  {R("avg(o_totalprice) FILTER (r_name = 'AFRICA')")} AS "AFRICA",
  {R("avg(o_totalprice) FILTER (r_name = 'EUROPE')")} AS "EUROPE" FROM obs GROUP BY 1""")
def agg_pivot(spark, d):
    df = observations(spark, d).withColumn("month", F.month("o_orderdate"))
    return rounded(agg.pivot_means(df, ["month"], "r_name", ["ASIA", "AFRICA", "EUROPE"],
                                   "o_totalprice"))


@query("agg_argminmax", f"""
(SELECT 'max' AS kind, o_orderdate, {R('o_totalprice')} AS o_totalprice FROM orders
  ORDER BY orders.o_totalprice DESC, o_orderdate LIMIT 1)
UNION ALL (SELECT 'min', o_orderdate, {R('o_totalprice')} FROM orders
  ORDER BY orders.o_totalprice, o_orderdate LIMIT 1)""")
def agg_argminmax(spark, d):
    return rounded(agg.extremes(table(spark, d, "orders"), "o_totalprice", "o_orderdate"))


@query("agg_bounds", """
SELECT min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events""")
def agg_bounds(spark, d):
    return agg.bounds(events(spark, d), "ts")


@query("agg_picklist", f"""
WITH {OBS} SELECT DISTINCT n_name FROM obs WHERE r_name = 'ASIA' ORDER BY 1""")
def agg_picklist(spark, d):
    return agg.picklist(observations(spark, d), "n_name", F.col("r_name") == "ASIA")


METRICS = f"""{R('avg(abs(y - p))')} AS mae, {R('sqrt(avg((y - p) * (y - p)))')} AS rmse,
  {R('avg(abs((y - p) / y)) FILTER (abs(y) > 0.001) * 100')} AS mape,
  {R('CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END')} AS r2,
  count(*) AS n"""


@query("agg_regression_metrics", f"""
WITH x AS (SELECT l_returnflag, l_linestatus, l_discount * 100 AS y, l_quantity / 5 AS p FROM lineitem)
SELECT l_returnflag, l_linestatus, {METRICS} FROM x GROUP BY 1, 2""")
def agg_regression_metrics(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_returnflag", "l_linestatus", (F.col("l_discount") * 100).alias("y_true"),
        (F.col("l_quantity") / 5).alias("y_pred"),
    )
    return rounded(agg.regression_metrics(df, ["l_returnflag", "l_linestatus"]))


@query("agg_detector_agreement", f"""
WITH f AS (SELECT l_quantity > 45 AS a, l_extendedprice > 80000 AS b FROM lineitem)
SELECT count(*) AS n_samples, count(*) FILTER (a) AS flagged_a, count(*) FILTER (b) AS flagged_b,
  count(*) FILTER (a AND b) AS flagged_both, count(*) FILTER (a OR b) AS flagged_either,
  {R('count(*) FILTER (a AND b) / count(*) FILTER (a OR b)')} AS jaccard FROM f""")
def agg_detector_agreement(spark, d):
    df = table(spark, d, "lineitem").select(
        (F.col("l_quantity") > 45).alias("a"), (F.col("l_extendedprice") > 80000).alias("b")
    )
    return rounded(agg.detector_agreement(df, "a", "b"))


@query("agg_flag_drivers", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(f'(avg({c}) FILTER (l_extendedprice > 80000) - avg({c})) / stddev_samp({c})')} AS mean_z FROM lineitem"
    for c in LINE))
def agg_flag_drivers(spark, d):
    df = table(spark, d, "lineitem").withColumn("flag", F.col("l_extendedprice") > 80000)
    return rounded(agg.flag_drivers(df, "flag", LINE))


@query("agg_flag_top_groups", """
SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_extendedprice > 80000
GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5""")
def agg_flag_top_groups(spark, d):
    flagged = table(spark, d, "lineitem").where(F.col("l_extendedprice") > 80000)
    return agg.top_values(flagged, "l_returnflag", 5)


@query("agg_linear_trend", f"""
WITH {OBS}, d AS (SELECT n_name, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS y FROM obs GROUP BY 1, 2),
x AS (SELECT n_name, y, date_diff('day', DATE '1995-01-01', day) AS x FROM d)
SELECT n_name, {R('regr_slope(y, x)')} AS slope, {R('regr_r2(y, x)')} AS r2,
  {R('regr_slope(y, x) * 365.25')} AS slope_per_year, CAST(regr_count(y, x) AS BIGINT) AS n FROM x GROUP BY 1""")
def agg_linear_trend(spark, d):
    daily = observations(spark, d).groupBy("n_name", F.to_date("o_orderdate").alias("day")).agg(
        F.avg("o_totalprice").alias("y")
    )
    x = F.datediff("day", F.lit("1995-01-01").cast("date"))
    fit = agg.linear_trend(daily, ["n_name"], "y", x)
    return rounded(fit.select("n_name", "slope", "r2", "slope_per_year", "n"))


@query("agg_trend_fit", f"""
WITH q AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS y FROM orders GROUP BY 1),
p AS (SELECT y, CAST(day - DATE '1995-01-01' AS DOUBLE) AS x FROM q)
SELECT {R('regr_slope(y, x)')} AS slope, {R('regr_r2(y, x)')} AS r2, CAST(regr_count(y, x) AS BIGINT) AS n FROM p""")
def agg_trend_fit(spark, d):
    return rounded(agg_trend_p_value(spark, d).drop("p_value"))


@query("agg_trend_p_value")
def agg_trend_p_value(spark, d):
    daily = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.avg("o_totalprice").alias("y")
    )
    x = F.datediff("day", F.lit("1995-01-01").cast("date"))
    return agg.linear_trend(daily, [], "y", x).select("slope", "r2", "n", "p_value")


QUAD = """q AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
c AS (SELECT avg(x) AS m FROM q), u AS (SELECT x - m AS u, y, x, m FROM q, c),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4,
  sum(y) AS t0, sum(u*y) AS t1, sum(u*u*y) AS t2, min(x) AS x_min, max(x) AS x_max, avg(x) AS m FROM u),
a AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS det FROM s),
b AS (SELECT *, (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / det AS a0,
  (n*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2)) / det AS a1,
  (n*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2)) / det AS a2 FROM a),
k AS (SELECT a2 AS c2, a1 - 2*a2*m AS c1, a0 - a1*m + a2*m*m AS c0, x_min, x_max FROM b)"""


def _quadratic(spark, d):
    df = table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y")
    )
    return agg.quadratic_fit(df, "x", "y")


@query("agg_quadratic_fit", f"""
WITH {QUAD} SELECT {R('c2')} AS c2, {R('c1')} AS c1, {R('c0')} AS c0, {R('x_min')} AS x_min, {R('x_max')} AS x_max FROM k""")
def agg_quadratic_fit(spark, d):
    return rounded(_quadratic(spark, d))


@query("agg_quadratic_curve", f"""
WITH {QUAD}, p AS (SELECT i, x_min + i * ((x_max - x_min) / 199) AS x, c0, c1, c2 FROM k, range(200) r(i))
SELECT CAST(i AS INTEGER) AS point, {R('x')} AS x, {R('c2*x*x + c1*x + c0')} AS y FROM p""")
def agg_quadratic_curve(spark, d):
    return rounded(agg.quadratic_curve(_quadratic(spark, d)))


@query("agg_minmax_weight", f"""
WITH m AS (SELECT l_suppkey, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1)
SELECT l_suppkey, {R('price')} AS price, {R('(price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ())')} AS weight FROM m""")
def agg_minmax_weight(spark, d):
    means = agg.group_means(table(spark, d, "lineitem"), ["l_suppkey"], {"price": "l_extendedprice"})
    return rounded(agg.minmax_weight(means, "price"))


@query("agg_cap_quantile", f"""
WITH m AS (SELECT l_suppkey, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1)
SELECT l_suppkey, {R('price')} AS price, {R('least(price, (SELECT quantile_cont(price, 0.95) FROM m))')} AS shown FROM m""")
def agg_cap_quantile(spark, d):
    means = agg.group_means(table(spark, d, "lineitem"), ["l_suppkey"], {"price": "l_extendedprice"})
    return rounded(agg.cap_at_quantile(means, "price", 0.95, "shown"))


@query("sl_topk", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def sl_topk(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(
        "o_orderkey", "o_totalprice"
    )


@query("sl_bottomk", f"""
SELECT n_name, {R('avg(c_acctbal)')} AS mean, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1 HAVING count(*) >= 10 ORDER BY avg(c_acctbal), n_name LIMIT 10""")
def sl_bottomk(spark, d):
    df = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return rounded(agg.ranking(df, "n_name", "c_acctbal", 10, least=10, largest=False))


@query("sl_topk_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
WHERE r <= 3""")
def sl_topk_per_group(spark, d):
    out = windows.top_per_group(
        table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")],
        3, rank="rank",
    )
    return out.select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("sl_hash_sample")
def sl_hash_sample(spark, d):
    return sampling.hash_sample(events(spark, d), ["event_id"], 1000).select("event_id", "value")


@query("sl_hash_split")
def sl_hash_split(spark, d):
    return sampling.hash_split(events(spark, d), ["event_id"]).groupBy("is_train").agg(
        F.count("*").alias("n")
    )


@query("sl_time_split", """
SELECT event_id, ts < TIMESTAMP '2024-01-25' AS is_train FROM events""")
def sl_time_split(spark, d):
    cutoff = F.lit("2024-01-25").cast("timestamp_ntz")
    return sampling.time_split(events(spark, d), "ts", cutoff).select("event_id", "is_train")


@query("st_union", f"""
WITH m AS (SELECT l_suppkey, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1)
SELECT l_suppkey, {R('mean')} AS mean, 'hot' AS side FROM (FROM m ORDER BY mean DESC, l_suppkey LIMIT 10)
UNION ALL SELECT l_suppkey, {R('mean')} AS mean, NULL FROM (FROM m ORDER BY mean, l_suppkey LIMIT 10)""")
def st_union(spark, d):
    lines = table(spark, d, "lineitem")
    hot = agg.ranking(lines, "l_suppkey", "l_extendedprice", 10).drop("n")
    cold = agg.ranking(lines, "l_suppkey", "l_extendedprice", 10, largest=False).drop("n")
    return rounded(hot.withColumn("side", F.lit("hot")).unionByName(cold, allowMissingColumns=True))


@query("st_intersect", """
SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier
INTERSECT SELECT c_nationkey FROM customer""")
def st_intersect(spark, d):
    return (
        table(spark, d, "nation").select("n_nationkey")
        .intersect(table(spark, d, "supplier").select("s_nationkey"))
        .intersect(table(spark, d, "customer").select("c_nationkey"))
    )


@query("agg_zone_means", f"""
WITH {OBS}, l AS (SELECT o_custkey, quantile_cont(latitude, 0.5) AS lat, avg(o_totalprice) AS price, count(*) AS n
  FROM obs GROUP BY 1 HAVING count(*) >= 10)
SELECT CASE WHEN abs(lat) <= 23.5 THEN 'Tropical' WHEN abs(lat) <= 35 THEN 'Subtropical'
  WHEN abs(lat) <= 55 THEN 'Temperate' ELSE 'Polar' END AS zone, {R('avg(price)')} AS mean, count(*) AS n FROM l GROUP BY 1""")
def agg_zone_means(spark, d):
    places = agg.group_summary(
        observations(spark, d), ORDERS, "o_custkey", {"price": "o_totalprice"}, 10,
        medians={"latitude": "latitude"},
    )
    return rounded(agg.binned_means(places, features.climate_zone(col("latitude")), "price", "zone"))


@query("agg_continent_means", f"""
WITH {OBS} SELECT CASE split_part(timezone, '/', 1) WHEN 'America' THEN 'Americas' WHEN 'Middle east' THEN 'Other'
  ELSE split_part(timezone, '/', 1) END AS continent, {R('avg(o_totalprice)')} AS price, count(*) AS n
FROM obs GROUP BY 1""")
def agg_continent_means(spark, d):
    df = observations(spark, d).withColumn("continent", prefix_group(F.col("timezone")))
    return rounded(agg.group_means(df, ["continent"], {"price": "o_totalprice"}, count="n"))
