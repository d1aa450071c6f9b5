"""Half-open interval bins ``(a, b]``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def bin_label(
    value: Column,
    edges: Sequence[float],
    labels: Sequence[str],
    include_lowest: bool = False,
    outside: str | None = None,
) -> Column:
    """Label of the bin ``(edges[i], edges[i+1]]`` that holds ``value``.

    ``include_lowest`` closes the first bin on the left. Values in no bin, and
    missing values, get ``outside`` (NULL by default).
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bin is needed")
    out = None
    for i, label in enumerate(labels):
        low = value >= edges[i] if include_lowest and i == 0 else value > edges[i]
        inside = low & (value <= edges[i + 1])
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out.otherwise(F.lit(outside))


def bin_interval(value: Column, edges: Sequence[float], include_lowest: bool = False) -> Column:
    """The bin as text, such as ``(5, 10]``; NULL outside all bins."""
    labels = [f"({a:g}, {b:g}]" for a, b in zip(edges, edges[1:])]
    return bin_label(value, edges, labels, include_lowest)


def width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Number 0..bins-1 of the equal-width bin; the last one is closed on the right."""
    raw = F.floor((value - low) / (high - low) * bins)
    inside = F.when(high > low, F.least(raw, F.lit(bins - 1))).otherwise(F.lit(0))
    return F.when(value.isNotNull(), inside).cast("int")
