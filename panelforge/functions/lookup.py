"""Constant lookups; the tables are a handful of literals inside the expression."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# Region group of the prefix of an IANA time zone name.
ZONE_GROUPS = {
    "Africa": "Africa",
    "America": "Americas",
    "Antarctica": "Antarctica",
    "Arctic": "Europe",
    "Asia": "Asia",
    "Atlantic": "Atlantic",
    "Australia": "Oceania",
    "Europe": "Europe",
    "Indian": "Indian Ocean",
    "Pacific": "Oceania",
    "US": "Americas",
}

# Names of the six levels of the US EPA air quality index.
EPA_LEVELS = {
    1: "Good",
    2: "Moderate",
    3: "Unhealthy (sensitive)",
    4: "Unhealthy",
    5: "Very unhealthy",
    6: "Hazardous",
}

# Country names as used by the boundary file.
BOUNDARY_NAMES = {
    "Congo": "Republic of the Congo",
    "Czech Republic": "Czech Republic",
    "Democratic Republic of Congo": "Democratic Republic of the Congo",
    "Guinea Bissau": "Guinea Bissau",
    "North Macedonia": "Macedonia",
    "Russia": "Russia",
    "Serbia": "Republic of Serbia",
    "South Korea": "South Korea",
    "Tanzania": "United Republic of Tanzania",
    "USA United States of America": "United States of America",
    "United States": "United States of America",
    "United States Of America": "United States of America",
}


def lookup(value: Column, table: Mapping, default: str | None = None) -> Column:
    """Value found in ``table``; ``default`` where it is not listed."""
    flat = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*flat), value)
    return found if default is None else F.coalesce(found, F.lit(default))


def prefix_group(
    text: Column,
    table: Mapping[str, str] = ZONE_GROUPS,
    delimiter: str = "/",
    default: str = "Other",
) -> Column:
    """Group of the part before the first delimiter."""
    prefix = F.substring_index(text, delimiter, 1)
    return lookup(prefix, table, default)


def alias_values(value: Column, table: Mapping[str, str] = BOUNDARY_NAMES) -> Column:
    """Replace listed values, keep the others."""
    return F.coalesce(lookup(value, table), value)


def code_labels(code: Column, table: Mapping[int, str] = EPA_LEVELS) -> Column:
    return lookup(code.cast("int"), table)
