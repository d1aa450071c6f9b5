"""Sources, filters, lookups, joins and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.binding import col
from panelforge.functions import (
    alias_values, code_labels, parse_ts, prefix_group,
)
from panelforge.functions.lookup import EPA_LEVELS
from panelforge.operators import features, filters, joins
from panelforge.plans.registry import (
    HOLEY, OBS, R, events, holey, observations, query, rounded, table,
)
from panelforge.sources import (
    read_csv, read_json, read_parquet, scratch_path, write_csv, write_json, write_parquet,
)


@query("io_csv_roundtrip", f"""
SELECT event_id, ts, user_id, event_type, {R('value')} AS value FROM events""")
def io_csv_roundtrip(spark, d):
    path = scratch_path(spark, "csv")
    write_csv(events(spark, d).drop("props"), path)
    schema = "event_id long, ts string, user_id long, event_type string, value double"
    return rounded(read_csv(spark, path, schema, ts=["ts"]))


@query("io_parquet_roundtrip", f"""
SELECT event_type, count(*) AS n, {R('avg(value)')} AS mean_value FROM events GROUP BY 1""")
def io_parquet_roundtrip(spark, d):
    path = scratch_path(spark, "parquet")
    write_parquet(events(spark, d), path, sort=["user_id", "ts"], partition_by=["event_type"])
    back = read_parquet(spark, path)
    return rounded(
        back.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    )


@query("io_json_roundtrip", f"""
SELECT event_type AS item, 'mean_value' AS metric, {R('avg(value)')} AS value FROM events GROUP BY 1""")
def io_json_roundtrip(spark, d):
    path = scratch_path(spark, "json")
    report = events(spark, d).groupBy(F.col("event_type").alias("item")).agg(
        F.avg("value").alias("mean_value")
    ).unpivot("item", "mean_value", "metric", "value")
    write_json(report, path)
    return rounded(read_json(spark, path, "item string, metric string, value double"))


@query("fn_parse_ts", """
SELECT event_id, try_cast(CASE WHEN event_type = 'error' THEN 'n/a ' || event_type
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS parsed FROM events""")
def fn_parse_ts(spark, d):
    text = F.when(F.col("event_type") == "error", F.lit("n/a error")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    return events(spark, d).select("event_id", parse_ts(text).alias("parsed"))


@query("fn_scalar", f"""
SELECT event_id, split_part(event_type, 'i', 1) AS head, trim('  ' || event_type || ' ') AS trimmed,
  {R('abs(value - 50)')} AS distance, {R('sqrt(value)')} AS root,
  {R('sin(2 * pi() * dayofyear(ts) / 365.25)')} AS doy_sin,
  {R('least(greatest(value, 5.0), 100.0)')} AS clipped,
  coalesce(value BETWEEN 10 AND 50, false) AS middling,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day_number
FROM events""")
def fn_scalar(spark, d):
    v = F.col("value")
    return rounded(events(spark, d).select(
        "event_id", F.split("event_type", "i")[0].alias("head"),
        F.trim(F.concat(F.lit("  "), F.col("event_type"), F.lit(" "))).alias("trimmed"),
        F.abs(v - 50).alias("distance"), F.sqrt(v).alias("root"),
        F.sin(F.dayofyear("ts") * (2 * F.pi() / 365.25)).alias("doy_sin"),
        F.least(F.greatest(v, F.lit(5.0)), F.lit(100.0)).alias("clipped"),
        F.coalesce(v.between(10, 50), F.lit(False)).alias("middling"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("day_number"),
    ))


@query("pf_drop_columns", "SELECT event_id, ts, user_id, event_type, value FROM events")
def pf_drop_columns(spark, d):
    return filters.drop_columns(events(spark, d), ["props", "not_a_column"])


@query("pf_prefix_lookup", f"""
WITH {OBS} SELECT o_orderkey, CASE split_part(timezone, '/', 1)
  WHEN 'Africa' THEN 'Africa' WHEN 'America' THEN 'Americas' WHEN 'Asia' THEN 'Asia'
  WHEN 'Europe' THEN 'Europe' ELSE 'Other' END AS continent FROM obs""")
def pf_prefix_lookup(spark, d):
    return observations(spark, d).select(
        "o_orderkey", prefix_group(F.col("timezone")).alias("continent")
    )


LINE_RULES = {"l_quantity": (2.0, 49.0), "l_discount": (0.0, 0.09), "l_extendedprice": (1000.0, 90000.0)}


@query("pf_range_filter", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
WHERE (l_quantity IS NULL OR l_quantity BETWEEN 2 AND 49)
  AND (l_discount IS NULL OR l_discount BETWEEN 0 AND CAST(0.09 AS DOUBLE))
  AND (l_extendedprice IS NULL OR l_extendedprice BETWEEN 1000 AND 90000)""")
def pf_range_filter(spark, d):
    return filters.keep_in_range(table(spark, d, "lineitem"), LINE_RULES).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )


@query("agg_rule_violations", """
WITH v AS (SELECT NOT (l_quantity BETWEEN 2 AND 49) AS a,
  NOT (l_discount BETWEEN 0 AND CAST(0.09 AS DOUBLE)) AS b,
  NOT (l_extendedprice BETWEEN 1000 AND 90000) AS c FROM lineitem)
SELECT 'l_quantity' AS rule, count(*) FILTER (a) AS violations FROM v
UNION ALL SELECT 'l_discount', count(*) FILTER (b) FROM v
UNION ALL SELECT 'l_extendedprice', count(*) FILTER (c) FROM v
UNION ALL SELECT 'rows_dropped', count(*) FILTER (a OR b OR c) FROM v""")
def agg_rule_violations(spark, d):
    return filters.rule_violations(table(spark, d, "lineitem"), LINE_RULES)


@query("pf_drop_missing_keys", f"""
WITH {HOLEY} SELECT event_id, user_id, value FROM holey
WHERE value IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL""")
def pf_drop_missing_keys(spark, d):
    return filters.require(holey(events(spark, d)), ["ts", "event_type", "value"]).select(
        "event_id", "user_id", "value"
    )


@query("pf_isin", f"""
WITH {OBS} SELECT o_orderkey, r_name FROM obs
WHERE r_name IN ('ASIA', 'EUROPE') AND month(o_orderdate) IN (5, 6, 7)""")
def pf_isin(spark, d):
    return observations(spark, d).where(
        F.col("r_name").isin("ASIA", "EUROPE") & F.month("o_orderdate").isin(5, 6, 7)
    ).select("o_orderkey", "r_name")


@query("pf_filter_set", """
SELECT event_id, ts, user_id, value FROM events
WHERE event_type = 'click' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def pf_filter_set(spark, d):
    return filters.filter_set(
        events(spark, d), "ts", {"event_type": "click", "user_id": "All"},
        start="2024-01-05", end="2024-01-20",
    ).select("event_id", "ts", "user_id", "value")


@query("pf_numeric_complete", f"""
WITH {HOLEY} SELECT event_id, user_id, value FROM holey
WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL AND value < 200""")
def pf_numeric_complete(spark, d):
    flagged = holey(events(spark, d)).withColumn(
        "outlier_iforest", F.coalesce(F.col("value") >= 200, F.lit(False))
    )
    return filters.predictor_rows(flagged, "value")


@query("pf_alias", f"""
WITH {OBS} SELECT o_orderkey, CASE n_name WHEN 'NATION_1' THEN 'First Nation'
  WHEN 'NATION_2' THEN 'Second Nation' ELSE n_name END AS geo_name FROM obs""")
def pf_alias(spark, d):
    names = {"NATION_1": "First Nation", "NATION_2": "Second Nation"}
    return observations(spark, d).select(
        "o_orderkey", alias_values(F.col("n_name"), names).alias("geo_name")
    )


@query("pf_code_labels", """
SELECT p_partkey, CASE p_size % 8 WHEN 1 THEN 'Good' WHEN 2 THEN 'Moderate'
  WHEN 3 THEN 'Unhealthy (sensitive)' WHEN 4 THEN 'Unhealthy' WHEN 5 THEN 'Very unhealthy'
  WHEN 6 THEN 'Hazardous' END AS epa_level FROM part""")
def pf_code_labels(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", code_labels(F.col("p_size") % 8, EPA_LEVELS).alias("epa_level")
    )


@query("pf_agreement", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE
  WHEN l_quantity > 45 AND l_extendedprice > 80000 THEN 'Both detectors'
  WHEN l_quantity > 45 THEN 'Isolation Forest only'
  WHEN l_extendedprice > 80000 THEN 'DBSCAN only' ELSE 'Normal' END AS agreement
FROM lineitem""")
def pf_agreement(spark, d):
    from panelforge.operators.anomaly import agreement

    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        agreement(F.col("l_quantity") > 45, F.col("l_extendedprice") > 80000).alias("agreement"),
    )


@query("pf_after_cutoff_head", """
WITH cut AS (SELECT o_custkey, max(o_orderdate) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
later AS (SELECT o.o_custkey, o.o_orderdate, o.o_orderkey,
    row_number() OVER (PARTITION BY o.o_custkey, o.o_orderdate ORDER BY o.o_orderkey) AS dup
  FROM orders o JOIN cut ON o.o_custkey = cut.o_custkey WHERE o.o_orderdate > cut.c),
days AS (SELECT o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS r
  FROM later WHERE dup = 1)
SELECT o_custkey, o_orderdate FROM days WHERE r <= 3""")
def pf_after_cutoff_head(spark, d):
    orders = table(spark, d, "orders")
    cutoff = orders.where(F.col("o_orderstatus") == "F").groupBy("o_custkey").agg(
        F.max("o_orderdate").alias("cutoff")
    )
    days = orders.select("o_custkey", "o_orderdate").distinct()
    return filters.after_cutoff(days, cutoff, ["o_custkey"], "o_orderdate", 3)


@query("jn_broadcast_lookup", """
SELECT c_custkey, coalesce(n_name, 'Unknown') AS n_name
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def jn_broadcast_lookup(spark, d):
    names = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.lookup_join(
        table(spark, d, "customer"), names, "c_nationkey", "n_name", "Unknown"
    ).select("c_custkey", "n_name")


@query("jn_group_stats", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey)')} AS deviation
FROM lineitem""")
def jn_group_stats(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    out = joins.with_group_stats(lines, ["l_suppkey"], {"_mean": F.avg("l_quantity")})
    return rounded(out.withColumn("deviation", F.col("l_quantity") - F.col("_mean"))
                   .drop("_mean", "l_quantity"))


# The shapes know three nations by the first names and two by others than the second, which stay unmatched.
NATION_ALIASES = {**{f"NATION_{i}": f"Republic {i}" for i in (3, 5, 7)}, **{f"NATION_{i}": f"Kingdom {i}" for i in (11, 13)}}
GEO = """geo AS (SELECT CASE n_name WHEN 'NATION_3' THEN 'Republic 3' WHEN 'NATION_5' THEN 'Republic 5'
  WHEN 'NATION_7' THEN 'Republic 7' WHEN 'NATION_11' THEN 'Kingdom 11' WHEN 'NATION_13' THEN 'Kingdom 13'
  ELSE n_name END AS geo_name, n_name, count(*) AS n FROM obs GROUP BY ALL),
  shapes AS (SELECT DISTINCT CASE WHEN s_nationkey IN (3, 5, 7) THEN 'Republic ' || s_nationkey
    ELSE 'NATION_' || s_nationkey END AS shape FROM supplier)"""


def _geo(spark, d):
    counts = observations(spark, d).groupBy("n_name").agg(F.count("*").alias("n"))
    key = F.col("s_nationkey")
    shapes = table(spark, d, "supplier").select(
        F.concat(F.when(key.isin(3, 5, 7), "Republic ").otherwise("NATION_"), key).alias("shape")
    ).distinct()
    return counts, shapes, alias_values(F.col("n_name"), NATION_ALIASES)


@query("jn_alias_left", f"""
WITH {OBS}, {GEO} SELECT n_name, geo_name, n, shape FROM geo LEFT JOIN shapes ON geo_name = shape""")
def jn_alias_left(spark, d):
    counts, shapes, name = _geo(spark, d)
    return joins.alias_join(counts, shapes, name, "shape")


@query("jn_unmatched_anti", f"""
WITH {OBS}, {GEO} SELECT n_name, geo_name, n FROM geo WHERE geo_name NOT IN (SELECT shape FROM shapes)""")
def jn_unmatched_anti(spark, d):
    counts, shapes, name = _geo(spark, d)
    return joins.unmatched(counts, shapes, name, "shape")


@query("jn_keep_listed", """
SELECT o_orderkey FROM orders WHERE o_orderpriority IN (
  SELECT o_orderpriority FROM orders GROUP BY 1 HAVING avg(o_totalprice) > (SELECT avg(o_totalprice) FROM orders))""")
def jn_keep_listed(spark, d):
    orders = table(spark, d, "orders")
    means = orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    costly = means.where(F.col("m") > orders.agg(F.avg("o_totalprice")).scalar())
    return joins.keep_listed(orders, costly.select("o_orderpriority"), "o_orderpriority").select("o_orderkey")


@query("fe_calendar", f"""
WITH {OBS} SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(month(o_orderdate) AS INTEGER) AS month,
  CAST(weekofyear(o_orderdate) AS INTEGER) AS week, CAST(day(o_orderdate) AS INTEGER) AS day,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week,
  CAST(dayofyear(o_orderdate) AS INTEGER) AS day_of_year,
  CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS is_weekend,
  CASE WHEN latitude >= 0 THEN CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter'
      WHEN month(o_orderdate) <= 5 THEN 'Spring' WHEN month(o_orderdate) <= 8 THEN 'Summer' ELSE 'Autumn' END
    ELSE CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Summer'
      WHEN month(o_orderdate) <= 5 THEN 'Autumn' WHEN month(o_orderdate) <= 8 THEN 'Winter' ELSE 'Spring' END
  END AS season FROM obs""")
def fe_calendar(spark, d):
    out = features.calendar(observations(spark, d), "o_orderdate", "latitude")
    return out.select(
        "o_orderkey", "year", "quarter", "month", "week", "day", "day_of_week", "day_of_year",
        "is_weekend", "season",
    )


@query("fe_derived", f"""
WITH {OBS} SELECT o_orderkey, {R('c_acctbal - o_totalprice')} AS temp_feels_diff,
  {R('c_acctbal / (o_totalprice + 273.15)')} AS humidity_temp_ratio FROM obs""")
def fe_derived(spark, d):
    out = features.derived(observations(spark, d), "c_acctbal", "o_totalprice", "c_acctbal")
    return rounded(out.select("o_orderkey", "temp_feels_diff", "humidity_temp_ratio"))


@query("fe_bins", """
SELECT event_id, CASE WHEN value >= 0 AND value <= 12 THEN 'Calm' WHEN value <= 29 AND value > 12 THEN 'Light'
  WHEN value <= 50 AND value > 29 THEN 'Moderate' WHEN value <= 75 AND value > 50 THEN 'Strong'
  WHEN value <= 1000 AND value > 75 THEN 'Storm' ELSE 'nan' END AS wind_category FROM events""")
def fe_bins(spark, d):
    return events(spark, d).select(
        "event_id", features.wind_class(F.col("value")).alias("wind_category")
    )


@query("fe_zone_bins", f"""
WITH {OBS} SELECT o_orderkey, CASE WHEN abs(latitude) <= 23.5 THEN 'Tropical'
  WHEN abs(latitude) <= 35 THEN 'Subtropical' WHEN abs(latitude) <= 55 THEN 'Temperate'
  WHEN abs(latitude) <= 90 THEN 'Polar' END AS zone FROM obs""")
def fe_zone_bins(spark, d):
    return observations(spark, d).select(
        "o_orderkey", features.climate_zone(col("latitude")).alias("zone")
    )
