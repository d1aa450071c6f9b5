"""Timestamps: parsing, calendar parts and seasons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The season of each month on the northern hemisphere.
NORTH_SEASONS = {
    "Winter": (12, 1, 2),
    "Spring": (3, 4, 5),
    "Summer": (6, 7, 8),
    "Autumn": (9, 10, 11),
}


def to_ntz(ts: Column) -> Column:
    """``date_trunc`` and friends give a zoned timestamp; this takes the zone off."""
    return ts.cast("timestamp_ntz")


def parse_ts(text: Column, fmt: str | None = None) -> Column:
    """Lenient parse: text that is no timestamp becomes NULL."""
    return to_ntz(F.try_to_timestamp(text, F.lit(fmt))) if fmt else text.try_cast("timestamp_ntz")


def epoch_micros(ts: Column, kind: str) -> Column:
    """Microseconds since 1970 in the order of ``ts``, whatever the zone of the session.

    A zone-less timestamp is taken apart, since a cast to a zoned one would
    fold hours around the change of clocks. ``kind`` is the Spark type name;
    numbers stand for themselves.
    """
    if kind == "timestamp":
        return F.unix_micros(ts)
    if kind == "date":
        return F.unix_date(ts).cast("long") * 86_400_000_000
    if kind == "timestamp_ntz":
        whole = F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
        return whole * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return ts.cast("long")


def season(ts: Column, latitude: Column) -> Column:
    """Season of the month, shifted by half a year south of the equator."""
    month = F.month(ts)
    shifted = F.when(latitude >= 0, month).otherwise((month + 5) % 12 + 1)
    out = None
    for name, months in NORTH_SEASONS.items():
        hit = shifted.isin(*months)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def calendar_columns(ts: Column, latitude: Column | None = None) -> dict[str, Column]:
    """Calendar parts; Monday is day 0 and weeks follow ISO 8601."""
    weekday = F.weekday(ts)
    parts = {
        "year": F.year(ts),
        "quarter": F.quarter(ts),
        "month": F.month(ts),
        "week": F.weekofyear(ts),
        "day": F.dayofmonth(ts),
        "day_of_week": weekday,
        "day_of_year": F.dayofyear(ts),
        "is_weekend": (weekday >= 5).cast("int"),
    }
    if latitude is not None:
        parts["season"] = season(ts, latitude)
    return parts
