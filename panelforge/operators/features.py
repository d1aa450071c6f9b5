"""Feature columns: calendar, derived measures, bins and the full feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.binding import Binding, col
from panelforge.functions import bin_label, calendar_columns
from panelforge.operators.windows import (
    BLOCK_ROWS, difference_columns, lag_columns, over_series, rolling_columns,
    rolling_range_column,
)

# Wind strength classes by speed in km/h.
WIND_EDGES = (0, 12, 29, 50, 75, 1000)
WIND_LABELS = ("Calm", "Light", "Moderate", "Strong", "Storm")

# Climate zones by absolute latitude.
ZONE_EDGES = (0.0, 23.5, 35.0, 55.0, 90.0)
ZONE_LABELS = ("Tropical", "Subtropical", "Temperate", "Polar")


def calendar(df: DataFrame, ts: str, latitude: str | None = None) -> DataFrame:
    parts = calendar_columns(col(ts), None if latitude is None else col(latitude))
    return df.withColumns(parts)


def derived(df: DataFrame, feels: str, temperature: str, humidity: str) -> DataFrame:
    """Felt minus measured temperature, and humidity per kelvin."""
    return df.withColumns(
        {
            "temp_feels_diff": col(feels) - col(temperature),
            "humidity_temp_ratio": col(humidity) / (col(temperature) + 273.15),
        }
    )


def wind_class(speed: Column) -> Column:
    """Wind strength; the text ``nan`` outside all classes."""
    return bin_label(speed, WIND_EDGES, WIND_LABELS, include_lowest=True, outside="nan")


def climate_zone(latitude: Column) -> Column:
    return bin_label(F.abs(latitude), ZONE_EDGES, ZONE_LABELS, include_lowest=True)


def feature_table(
    df: DataFrame, b: Binding, latitude: str | None = None, feels: str | None = None,
    temperature: str = "temperature_celsius", humidity: str = "humidity",
    pressure: str = "pressure_mb", wind: str | None = "wind_kph",
    steps: Sequence[int] = (1, 2, 3, 7, 14), windows: Sequence[int] = (3, 7, 14, 30),
    block_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """All features. Every window shares one partitioning and order, hence one shuffle and sort."""

    def window_columns(w):
        return {
            **lag_columns(w, b.values, steps),
            **rolling_columns(w, b.values, windows),
            **difference_columns(
                w, pressure, {"pressure_change_1d": (1, 1.0), "pressure_trend_7d": (7, 7.0)}
            ),
            "temp_range_7d": rolling_range_column(w, temperature),
        }

    out = calendar(df, b.ts, latitude)
    if feels is not None:
        out = derived(out, feels, temperature, humidity)
    if wind is not None:
        out = out.withColumn("wind_category", wind_class(col(wind)))
    return over_series(out, b, window_columns, max(*steps, *windows, 7), block_rows)
