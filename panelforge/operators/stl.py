"""Seasonal-trend decomposition by loess (Cleveland et al., 1990), one task per series.

A series is a daily one: a few thousand rows, whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelforge.binding import col
from panelforge.session import by_group


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


class Loess:
    """Local linear smoother of ``n`` evenly spaced values, ``ends`` points longer on both sides.

    The kernel of a point depends only on where its window lies around it. All
    inner points share one kernel, so their weighted moments are convolutions;
    the few points near the ends have kernels of their own.
    """

    def __init__(self, n: int, span: int, ends: int = 0):
        self.width = width = min(span, n)
        at = np.arange(-ends, n + ends)
        self.start = np.clip(at - width // 2, 0, n - width)
        offset = self.start - at
        self.inner = offset == -(width // 2)
        self.kernel = self._kernel(np.array([-(width // 2)]), span, n)
        self.edges = []
        for start in (0, n - width):
            rows = np.flatnonzero(~self.inner & (self.start == start))
            if len(rows):
                self.edges.append((rows, start, self._kernel(offset[rows], span, n)))
                self.inner[rows] = False
            if n == width:
                break

    def _kernel(self, offset: np.ndarray, span: int, n: int) -> list[np.ndarray]:
        distance = offset[:, None] + np.arange(self.width)[None, :]
        reach = np.maximum(np.abs(distance).max(axis=1, keepdims=True).astype(float), 1e-12)
        if span > n:
            reach += (span - n) // 2
        w = np.clip(1 - (np.abs(distance) / reach) ** 3, 0, None) ** 3
        x = distance / reach
        return [w, w * x, w * x * x]

    def __call__(self, y: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Smooth the last axis of ``y``."""
        w = np.ones_like(y) if weights is None else weights
        out = np.empty(y.shape[:-1] + (len(self.start),))
        if self.inner.any():
            at = self.start[self.inner]
            moments = [self._slide(v, k[0])[..., at] for v, k in self._terms(w, y, self.kernel)]
            out[..., self.inner] = self._line(*moments)
        for rows, start, kernel in self.edges:
            window = slice(start, start + self.width)
            moments = [v[..., window] @ k.T for v, k in self._terms(w, y, kernel)]
            out[..., rows] = self._line(*moments)
        return out

    @staticmethod
    def _terms(w, y, kernel):
        return [(w, kernel[0]), (w, kernel[1]), (w, kernel[2]), (w * y, kernel[0]), (w * y, kernel[1])]

    @staticmethod
    def _slide(v: np.ndarray, kernel: np.ndarray) -> np.ndarray:
        if v.ndim == 1:
            return np.convolve(v, kernel[::-1], "valid")
        return np.stack([np.convolve(row, kernel[::-1], "valid") for row in v])

    @staticmethod
    def _line(s0, s1, s2, t0, t1):
        """Value at 0 of the weighted line; the plain mean where the line is not determined."""
        s0 = np.maximum(s0, 1e-300)
        spread = s2 - s1 * s1 / s0
        slope = np.where(spread > 1e-9 * s0, (t1 - s1 * t0 / s0) / np.where(spread > 1e-9 * s0, spread, 1), 0.0)
        return (t0 - slope * s1) / s0


def loess(y: np.ndarray, span: int, weights: np.ndarray | None = None, ends: int = 0) -> np.ndarray:
    return Loess(len(y), span, ends)(y, weights)


def _average(x: np.ndarray, n: int) -> np.ndarray:
    total = np.cumsum(np.concatenate(([0.0], x)))
    return (total[n:] - total[:-n]) / n


def decompose(
    y: np.ndarray, period: int, seasonal: int = 7, robust: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal part and robustness weights."""
    n = len(y)
    trend_loess = Loess(n, _odd(1.5 * period / (1 - 1.5 / seasonal)))
    low_loess = Loess(n, _odd(period + 1))
    # Phases are smoothed together; the first ones may have one value more.
    longer = n % period
    groups = [
        (np.arange(phases.start, phases.stop)[:, None] + np.arange(size)[None, :] * period, Loess(size, seasonal, 1))
        for phases, size in ((range(longer), n // period + 1), (range(longer, period), n // period))
        if len(phases)
    ]
    inner, outer = (2, 15) if robust else (5, 0)
    trend, season, weights = np.zeros(n), np.zeros(n), None
    for _ in range(outer + 1):
        for _ in range(inner):
            detrended = y - trend
            cycle = np.empty(n + 2 * period)
            for index, smoother in groups:
                smooth = smoother(detrended[index], None if weights is None else weights[index])
                # Position p of the series is p + period here; the smooth starts one cycle early.
                cycle[index[:, :1] + np.arange(smooth.shape[1])[None, :] * period] = smooth
            low = _average(_average(_average(cycle, period), period), 3)
            season = cycle[period:-period] - low_loess(low)
            trend = trend_loess(y - season, weights)
        if outer:
            residual = np.abs(y - season - trend)
            scale = 6 * np.median(residual)
            ratio = residual / max(scale, 1e-300)
            weights = np.where(ratio <= 0.001, 1.0, np.where(ratio >= 0.999, 0.0, (1 - ratio**2) ** 2))
    return trend, season, np.ones(n) if weights is None else weights


def stl(
    daily: DataFrame, value: str, period: int, series: Sequence[str], date: str = "date",
    seasonal: int = 7, robust: bool = True,
) -> DataFrame:
    """Add trend, seasonal, resid and weight; series under two periods keep them NULL."""
    keys = list(series)
    kinds = dict(daily.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"`{date}` date", f"`{value}` double",
                        "trend double, seasonal double, resid double, weight double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        y = pdf[value].to_numpy(float)
        if len(y) < 2 * period:
            return pdf.assign(trend=np.nan, seasonal=np.nan, resid=np.nan, weight=np.nan)
        trend, season, weight = decompose(y, period, seasonal, robust)
        return pdf.assign(trend=trend, seasonal=season, resid=y - trend - season, weight=weight)

    rows = daily.select(*[col(k) for k in keys], col(date), col(value).cast("double").alias(value))
    parts = by_group(rows, keys).groupBy(*[col(k) for k in keys]).applyInPandas(run, schema)
    return parts.withColumns(
        {c: F.when(~F.isnan(c), F.col(c)) for c in ("trend", "seasonal", "resid", "weight")}
    )
