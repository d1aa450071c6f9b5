"""Registry of queries and the bindings of the operators to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.binding import Binding, col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EVENTS = Binding(("user_id",), "ts", ("event_id",), ("value",))
ORDERS = Binding(("o_custkey",), "o_orderdate", ("o_orderkey",), ("o_totalprice",))


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark, folder):
    return table(spark, folder, "events")


def holey(df: DataFrame) -> DataFrame:
    """Events whose value and type are missing for errors, to exercise the NULL rules."""
    bad = F.col("event_type") == "error"
    return df.withColumns(
        {"value": F.when(~bad, F.col("value")), "event_type": F.when(~bad, F.col("event_type"))}
    )


HOLEY = """holey AS (
  SELECT event_id, ts, user_id, props,
    CASE WHEN event_type <> 'error' THEN value END AS value,
    CASE WHEN event_type <> 'error' THEN event_type END AS event_type
  FROM events)"""


def observations(spark, folder) -> DataFrame:
    """Orders with customer, nation and region; the nation stands in for a place on the map."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    places = n.join(r, n.n_regionkey == r.r_regionkey)
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumns(
            {
                "latitude": (F.col("n_nationkey") * 7 - 90).cast("double"),
                "longitude": (F.col("n_nationkey") * 15 - 180).cast("double"),
                "timezone": F.concat(F.initcap("r_name"), F.lit("/"), F.col("n_name")),
            }
        )
    )


OBS = """obs AS (
  SELECT o.*, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment, n.n_nationkey, n.n_name, r.r_name,
    CAST(n_nationkey * 7 - 90 AS DOUBLE) AS latitude,
    CAST(n_nationkey * 15 - 180 AS DOUBLE) AS longitude,
    upper(r_name[1]) || lower(r_name[2:]) || '/' || n_name AS timezone
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey)"""


SHIFT = 3e-8


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Round the doubles of a result for comparison.

    The small shift keeps exact halves, which engines round differently, off
    the rounding boundary; adding zero removes negative zeros. ``other`` gives
    the digits of single columns.
    """
    fixes = {
        n: F.round(col(n) + F.lit(SHIFT), other.get(n, digits)) + F.lit(0.0)
        for n, kind in df.dtypes
        if kind == "double"
    }
    return df.withColumns(fixes) if fixes else df


def R(expression: str, digits: int = 6) -> str:
    """The SQL side of :func:`rounded`."""
    return f"(round(CAST({expression} AS DOUBLE) + CAST(3e-8 AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"
