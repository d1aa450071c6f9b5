"""Joins against lookup tables and statistics.

Tables from files carry their size, so the planner broadcasts small ones by
itself. Aggregates do not; they are written down first (see ``durable``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.binding import col
from panelforge.session import durable


def lookup_join(
    df: DataFrame, table: DataFrame, on: str, value: str, default: str | None = None
) -> DataFrame:
    """Add ``value`` from a lookup table with one row per ``on``; keep unmatched rows."""
    out = df.join(table.select(col(on), col(value)), on, "left")
    if default is None:
        return out
    return out.withColumn(value, F.coalesce(col(value), F.lit(default)))


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Group statistics on every row: aggregate first, then join, so no group meets in one task."""
    table = df.groupBy(*[col(k) for k in keys]).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(durable(table), list(keys), "left")


def keep_listed(df: DataFrame, listed: DataFrame, on: str) -> DataFrame:
    """Rows whose value is among those that an earlier query found."""
    return df.join(durable(listed), on, "left_semi")


def alias_join(
    df: DataFrame, boundaries: DataFrame, name: Column, boundary: str
) -> DataFrame:
    """Match names after aliasing; names without a boundary keep a NULL."""
    named = df.withColumn("geo_name", name)
    return named.join(boundaries, F.col("geo_name") == col(boundary), "left")


def unmatched(df: DataFrame, boundaries: DataFrame, name: Column, boundary: str) -> DataFrame:
    """Rows whose aliased name has no boundary."""
    named = df.withColumn("geo_name", name)
    return named.join(boundaries, F.col("geo_name") == col(boundary), "left_anti")
