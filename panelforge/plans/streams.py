"""Queries that read the events as a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.plans.registry import EVENTS, R, events, query, rounded
from panelforge.sources import scratch_path
from panelforge.streaming import arrivals, daily_means, deduped, finished


def _arrivals(spark, d):
    # A pattern, as a stream reads folders or patterns and the table may be a single file.
    return arrivals(spark, f"{d}/events.parquet*", events(spark, d).schema, "ts", "1 day")


@query("str_dedupe", """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(event_id) AS first_id, max(event_id) AS last_id
FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1) GROUP BY 1""")
def str_dedupe(spark, d):
    """Events deduplicated as they arrive, by type."""
    got = finished(deduped(_arrivals(spark, d), EVENTS), scratch_path(spark, "stream"))
    return got.groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query("str_daily_means", f"""SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS date, count(*) AS n, {R('avg(value)')} AS mean_value
FROM events WHERE date_trunc('day', ts) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) GROUP BY 1, 2""")
def str_daily_means(spark, d):
    """Daily means by type, of the days that the watermark of a day has closed."""
    got = daily_means(_arrivals(spark, d), ["event_type"], "ts", {"mean_value": F.col("value")})
    return rounded(finished(got, scratch_path(spark, "stream")))
