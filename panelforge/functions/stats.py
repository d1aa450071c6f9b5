"""Small statistical expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """Standardised value; a constant column is only centred."""
    return (value - mean) / F.when(std > 0, std).otherwise(F.lit(1.0))


def capped(value: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Clip to the bounds; a missing value stays missing."""
    out = value
    if low is not None:
        out = F.when(out < low, low).otherwise(out)
    if high is not None:
        out = F.when(out > high, high).otherwise(out)
    return out


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for positive arguments: Stirling's series, eight steps up."""
    up = z + 8
    series = 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5) - 1 / (1680 * up**7) + 1 / (1188 * up**9)
    value = (up - 0.5) * F.log(up) - up + 0.9189385332046727 + series  # half the logarithm of 2 pi
    for k in range(8):
        value = value - F.log(z + k)
    return value


def incomplete_beta(x: Column, a: Column, b: Column, steps: int = 600) -> Column:
    """Regularised incomplete beta function by ``steps`` terms of its continued fraction (Lentz's method).

    The fraction is used on the side of the mean on which it converges fast.
    """
    swap = x > (a + 1) / (a + b + 2)
    p, q = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    v = F.when(swap, 1 - x).otherwise(x)
    one = F.lit(1.0)

    def step(s: Column, k: Column) -> Column:
        m, x_, p_, q_ = k.cast("double"), s["x"], s["p"], s["q"]
        even = m * (q_ - m) * x_ / ((p_ + 2 * m - 1) * (p_ + 2 * m))
        odd = -(p_ + m) * (p_ + q_ + m) * x_ / ((p_ + 2 * m) * (p_ + 2 * m + 1))
        d1 = 1 / (1 + even * s["d"])
        c1 = 1 + even / s["c"]
        d2 = 1 / (1 + odd * d1)
        c2 = 1 + odd / c1
        return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"), x_.alias("x"), p_.alias("p"), q_.alias("q"))

    d = 1 / (1 - (p + q) * v / (p + 1))
    start = F.struct(one.alias("c"), d.alias("d"), d.alias("h"), v.alias("x"), p.alias("p"), q.alias("q"))
    h = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["h"])
    front = F.exp(p * F.log(v) + q * F.log(1 - v) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p
    value = F.when(v > 0, front * h).otherwise(F.lit(0.0))
    return F.when(swap, 1 - value).otherwise(value)


def line_p_value(r2: Column, n: Column) -> Column:
    """Two-sided p-value of the slope of a least-squares line, by Student's t with n - 2 degrees of freedom."""
    free = (n - 2).cast("double")
    return F.when((free > 0) & (r2 >= 0), incomplete_beta(1 - F.least(r2, F.lit(1.0)), free / 2, F.lit(0.5)))


def regression_metric_columns(actual: Column, predicted: Column) -> dict[str, Column]:
    """Aggregates for MAE, RMSE, MAPE (percent) and R2, all in one pass.

    MAPE skips actuals within 0.001 of zero; R2 is NULL when the actuals do
    not vary. Rows with a missing side must be filtered out before.
    """
    error = actual - predicted
    spread = F.var_pop(actual) * F.count(actual)
    return {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "mape": F.avg(F.when(F.abs(actual) > 1e-3, F.abs(error / actual))) * 100,
        "r2": F.when(spread > 0, 1 - F.sum(error * error) / spread),
    }
