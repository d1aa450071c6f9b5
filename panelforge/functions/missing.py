"""Missing values and range rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.binding import col

FLOATS = ("double", "float")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL once, at the source: Spark aggregates do not skip NaN."""
    fixes = {
        name: F.when(~F.isnan(col(name)), col(name))
        for name, kind in df.dtypes
        if kind in FLOATS
    }
    return df.withColumns(fixes) if fixes else df


def in_range(name: str, low: float, high: float) -> Column:
    """True for values inside the closed range and for missing values."""
    c = col(name)
    return c.isNull() | c.between(low, high)


def violations(rules: Mapping[str, tuple[float, float]]) -> dict[str, Column]:
    return {name: ~in_range(name, low, high) for name, (low, high) in rules.items()}
