"""Additive curves: piecewise linear trend, weekly and yearly Fourier terms.

The most probable curve under the priors of Taylor and Letham (2018): normal
for the Fourier terms, Laplace for the changes of slope, found by reweighted
least squares. Bands add the noise and the chance of further slope changes.
"""

from __future__ import annotations

import numpy as np

from panelforge.operators.arima import BAND

CHANGES, CHANGE_SHARE = 25, 0.8
CHANGE_SCALE, SEASON_SCALE = 0.05, 10.0
TERMS = ((365.25, 10), (7.0, 3))  # period in days, number of harmonics


def design(days: np.ndarray, t: np.ndarray, knots: np.ndarray) -> np.ndarray:
    columns = [np.ones_like(t), t]
    columns += [np.maximum(t - k, 0.0) for k in knots]
    for period, harmonics in TERMS:
        for h in range(1, harmonics + 1):
            angle = 2 * np.pi * h * days / period
            columns += [np.sin(angle), np.cos(angle)]
    return np.column_stack(columns)


def fit_predict(
    days: np.ndarray, y: np.ndarray, at: np.ndarray, rounds: int = 12
) -> tuple[np.ndarray, np.ndarray]:
    """Curve fitted to ``(days, y)`` evaluated at the days ``at``, and the width of its band.

    Days are counted from 1970-01-01, so the seasons are tied to the calendar.
    """
    first, span = days[0], max(days[-1] - days[0], 1)
    scale = np.abs(y).max() or 1.0
    count = min(CHANGES, max(int(len(days) * CHANGE_SHARE) - 1, 0))
    place = np.linspace(0, int(len(days) * CHANGE_SHARE) - 1, count + 1).round().astype(int)[1:]
    t, t_at = (days - first) / span, (at - first) / span
    knots = t[place] if count else np.empty(0)
    x, target = design(days, t, knots), y / scale
    changes = slice(2, 2 + count)
    penalty = np.full(x.shape[1], 1 / SEASON_SCALE**2)
    penalty[:2] = 1 / 5.0**2
    gram, moment = x.T @ x, x.T @ target
    sigma2, delta = max(np.var(target), 1e-12), np.full(count, CHANGE_SCALE)
    for _ in range(rounds):
        penalty[changes] = 1 / (CHANGE_SCALE * np.maximum(np.abs(delta), 1e-6))
        beta = np.linalg.lstsq(gram + sigma2 * np.diag(penalty), moment, rcond=None)[0]
        delta = beta[changes]
        sigma2 = max(float(np.mean((target - x @ beta) ** 2)), 1e-12)
    curve = design(at, t_at, knots) @ beta
    # Slope changes beyond the last day come at the past rate with the past mean size.
    size = np.abs(delta).mean() if count else 0.0
    beyond = np.maximum(t_at - 1.0, 0.0)
    drift = (count / CHANGE_SHARE) * 2 * size**2 * beyond**3 / 3
    return curve * scale, BAND * np.sqrt(sigma2 + drift) * scale
