"""Row filters and column choices; all are pushed into the scan where possible."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelforge.binding import col
from panelforge.functions.missing import in_range, violations
from panelforge.operators.aggregates import to_long
from panelforge.session import durable

# Twin columns in other units, not needed next to the metric ones.
REDUNDANT = (
    "temperature_fahrenheit", "feels_like_fahrenheit", "wind_mph", "gust_mph",
    "pressure_in", "precip_in", "visibility_miles", "last_updated_epoch",
)

# Physically plausible ranges of the weather measures.
PLAUSIBLE = {
    "latitude": (-90.0, 90.0),
    "longitude": (-180.0, 180.0),
    "temperature_celsius": (-90.0, 60.0),
    "humidity": (0.0, 100.0),
    "precip_mm": (0.0, 500.0),
    "pressure_mb": (850.0, 1090.0),
    "wind_kph": (0.0, 410.0),
    "cloud": (0.0, 100.0),
    "uv_index": (0.0, 17.0),
    "visibility_km": (0.0, 100.0),
}

Rules = Mapping[str, tuple[float, float]]


def drop_columns(df: DataFrame, names: Sequence[str] = REDUNDANT) -> DataFrame:
    """Drop the listed columns that exist."""
    return df.drop(*names)


def applicable(df: DataFrame, rules: Rules) -> Rules:
    return {name: rule for name, rule in rules.items() if name in df.columns}


def keep_in_range(df: DataFrame, rules: Rules = PLAUSIBLE) -> DataFrame:
    """Rows whose values are all inside their closed ranges or missing."""
    for name, (low, high) in applicable(df, rules).items():
        df = df.where(in_range(name, low, high))
    return df


def rule_violations(df: DataFrame, rules: Rules = PLAUSIBLE) -> DataFrame:
    """Violations of each rule, and the rows that break any (``rows_dropped``)."""
    broken = violations(applicable(df, rules))
    any_broken = F.lit(False)
    for b in broken.values():
        any_broken = any_broken | b
    counts = {name: F.count_if(b) for name, b in broken.items()}
    counts["rows_dropped"] = F.count_if(any_broken)
    return to_long(df, counts, "rule", "violations")


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows that miss any of the columns."""
    return df.dropna(subset=list(columns))


def filter_set(
    df: DataFrame, ts: str, equal: Mapping[str, str | None], start: str | None = None,
    end: str | None = None, everything: str = "All",
) -> DataFrame:
    """Equality filters and a closed range of days; ``everything`` or None filters nothing."""
    for name, value in equal.items():
        if value is not None and value != everything:
            df = df.where(col(name) == value)
    # Bounds on the bare column reach the scan; a cast of it would not.
    if start is not None:
        df = df.where(col(ts) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(col(ts) < F.date_add(F.lit(end).cast("date"), 1))
    return df


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns by schema; booleans are not numeric."""
    left_out = set(exclude)
    return [
        n for n, kind in df.dtypes
        if n not in left_out and (kind in NUMERIC or kind.startswith("decimal"))
    ]


# Columns that would give the target away.
NOT_PREDICTORS = (
    "temperature_celsius", "feels_like_celsius", "temp_feels_diff", "humidity_temp_ratio",
    "temp_range_7d", "last_updated", "outlier_iforest", "latitude", "longitude",
)


def predictor_rows(
    df: DataFrame, target: str, exclude: Sequence[str] = NOT_PREDICTORS,
    flag: str | None = "outlier_iforest", keep: Sequence[str] = (),
) -> DataFrame:
    """Complete rows of all numeric predictors and the target, without flagged rows.

    ``keep`` carries identifiers along; they are not predictors.
    """
    if flag is not None:
        df = df.where(~col(flag))
    predictors = numeric_columns(df, [*exclude, target, *keep])
    used = [*predictors, target]
    return df.select(*[col(c) for c in keep], *[col(c) for c in used]).dropna(subset=used)


def after_cutoff(
    df: DataFrame, cutoff: DataFrame, series: Sequence[str], ts: str, horizon: int
) -> DataFrame:
    """First ``horizon`` rows of each series after the cutoff of that series.

    ``cutoff`` holds one row ``(series..., cutoff)`` per series.
    """
    later = df.join(durable(cutoff), list(series)).where(col(ts) > F.col("cutoff")).drop("cutoff")
    w = Window.partitionBy(*[col(s) for s in series]).orderBy(col(ts))
    return later.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= horizon).drop("_r")
