"""ARIMA with an optional season, fitted to every series in its own task.

Conditional least squares: the parameters minimise the squared one-step
errors, found by Levenberg-Marquardt steps.
"""

from __future__ import annotations

import numpy as np

Order = tuple[int, int, int]
BAND = 1.959963984540054  # 97.5 % point of the normal distribution


def difference(y: np.ndarray, d: int, seasonal_d: int, period: int) -> np.ndarray:
    for _ in range(d):
        y = y[1:] - y[:-1]
    for _ in range(seasonal_d):
        y = y[period:] - y[:-period]
    return y


def polynomials(
    params: np.ndarray, order: Order, seasonal: Order, period: int
) -> tuple[np.ndarray, np.ndarray]:
    """AR and MA lag polynomials with the seasonal factors multiplied in."""
    (p, _, q), (sp, _, sq) = order, seasonal
    ar, ma, sar, sma = np.split(params, np.cumsum([p, q, sp]))

    def spread(coefficients, gap, sign):
        out = np.zeros(len(coefficients) * gap + 1)
        out[0] = 1.0
        out[gap::gap] = sign * coefficients
        return out

    gap = max(period, 1)
    return (
        np.convolve(spread(ar, 1, -1), spread(sar, gap, -1)),
        np.convolve(spread(ma, 1, 1), spread(sma, gap, 1)),
    )


def one_step_errors(
    params: np.ndarray, w: np.ndarray, order: Order, seasonal: Order, period: int
) -> np.ndarray:
    """Errors of the one-step predictions; zero before the first full lag."""
    ar, ma = polynomials(params, order, seasonal, period)
    skip = len(ar) - 1
    driven = np.convolve(w, ar)[skip:len(w)].tolist()
    lags = [(j, float(m)) for j, m in enumerate(ma) if j and m]
    if not lags:
        return np.concatenate((np.zeros(skip), driven))
    errors: list[float] = []
    for t, value in enumerate(driven):
        for j, m in lags:
            if j <= t:
                value -= m * errors[t - j]
        errors.append(value)
        if abs(value) > 1e100:  # not invertible; no such fit can win
            return np.full(len(w), np.inf)
    return np.concatenate((np.zeros(skip), errors))


def fit(
    w: np.ndarray, order: Order, seasonal: Order = (0, 0, 0), period: int = 0, rounds: int = 40
) -> np.ndarray:
    """Parameters in the order AR, MA, seasonal AR, seasonal MA."""
    size = order[0] + order[2] + seasonal[0] + seasonal[2]
    params = np.full(size, 0.05)
    if not size:
        return params
    start = len(polynomials(params, order, seasonal, period)[0]) - 1

    def errors(p):
        return one_step_errors(p, w, order, seasonal, period)[start:]

    current = errors(params)
    loss, damping = float(current @ current), 1e-3
    for _ in range(rounds):
        jacobian = np.empty((len(current), size))
        for i in range(size):
            shifted = params.copy()
            shifted[i] += 1e-6
            jacobian[:, i] = (errors(shifted) - current) / 1e-6
        normal, gradient = jacobian.T @ jacobian, jacobian.T @ current
        improved = False
        for _ in range(8):
            step = np.linalg.lstsq(
                normal + damping * np.diag(np.diag(normal) + 1e-12), -gradient, rcond=None
            )[0]
            trial = errors(params + step)
            trial_loss = float(trial @ trial) if np.isfinite(trial).all() else np.inf
            if trial_loss < loss:
                improved = True
                break
            damping *= 5
        if not improved:
            break
        gain = (loss - trial_loss) / max(loss, 1e-300)
        params, current, loss = params + step, trial, trial_loss
        damping = max(damping / 5, 1e-9)
        if gain < 1e-9:
            break
    return params


def days_needed(order: Order, seasonal: Order = (0, 0, 0), period: int = 0) -> int:
    """Days before the test window from which the model is fitted."""
    lost = order[1] + seasonal[1] * period
    longest = order[0] + seasonal[0] * period + max(order[2], seasonal[2] * period)
    return lost + 3 * longest + 10


def backtest(
    y: np.ndarray, test: int, order: Order, seasonal: Order = (0, 0, 0), period: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """One-step predictions of the last ``test`` values and the width of their 95 % band.

    The fit sees only the values before. Each prediction uses the true values
    up to the day before. With fewer than :func:`days_needed` days before the test
    window this repeats the last value; the forecasters give NULL there instead.
    """
    train = len(y) - test
    lost = order[1] + seasonal[1] * period
    if train < days_needed(order, seasonal, period):
        previous = np.concatenate(([np.nan], y[:-1]))[train:]
        spread = np.std(np.diff(y[:train])) if train > 2 else np.nan
        return previous, np.full(test, BAND * spread)
    w = difference(y, order[1], seasonal[1], period)
    params = fit(w[: train - lost], order, seasonal, period)
    errors = one_step_errors(params, w, order, seasonal, period)
    skip = len(polynomials(params, order, seasonal, period)[0]) - 1
    known = errors[skip: train - lost]
    sigma = np.sqrt(known @ known / max(len(known) - len(params), 1))
    return y[train:] - errors[train - lost:], np.full(test, BAND * sigma)
