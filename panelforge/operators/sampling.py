"""Samples and splits by hash: repeatable, and the same under any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.binding import col


def row_hash(ids: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*[col(c) for c in ids], F.lit(seed))


def hash_sample(df: DataFrame, ids: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, those with the smallest hash; a top-k without a full sort."""
    return df.orderBy(row_hash(ids, seed), *[col(c) for c in ids]).limit(n)


def hash_split(
    df: DataFrame, ids: Sequence[str], train_percent: int = 80, seed: int = 42,
    name: str = "is_train",
) -> DataFrame:
    """Mark about ``train_percent`` of the rows as training rows."""
    return df.withColumn(name, F.pmod(row_hash(ids, seed), F.lit(100)) < train_percent)


def time_split(df: DataFrame, ts: str, cutoff: Column, name: str = "is_train") -> DataFrame:
    """Mark the rows before ``cutoff``; unlike a random split it keeps neighbours together."""
    return df.withColumn(name, col(ts) < cutoff)
