"""Regular series: resampling, gap filling, climatology and supervised rows.

A daily series has one row per calendar day, so the windows here sort a few
thousand rows per series whatever the size of the input; the work spreads over
the series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.binding import col


def _series_window(series: Sequence[str]):
    return Window.partitionBy(*[col(s) for s in series])


def fill_calendar(
    table: DataFrame, columns: Sequence[str], series: Sequence[str], date: str, unit: str = "day"
) -> DataFrame:
    """Add the missing periods between the first and the last one of each series.

    Each row also yields the periods up to the next row, so no calendar has to
    be built and joined.
    """
    step = F.expr(f"INTERVAL 1 {unit}")
    following = F.lead(col(date)).over(_series_window(series).orderBy(date))
    until = F.coalesce(F.to_date(following - step), col(date))
    periods = F.explode(F.sequence(col(date), F.col("_until"), step))
    out = table.withColumn("_until", until).withColumn("_period", periods)
    own = F.col("_period") == col(date)
    return out.withColumns({c: F.when(own, col(c)) for c in columns}).withColumn(
        date, F.col("_period")
    ).drop("_period", "_until")


def resample(
    df: DataFrame, ts: str, means: Mapping[str, str], series: Sequence[str] = (),
    unit: str = "day", date: str = "date", count: str = "n_obs", keep_empty: bool = True,
) -> DataFrame:
    """Mean per period with empty periods kept as NULL; ``unit`` is day or month.

    The rows shrink to one per period in the first aggregation; all that
    follows works on that small table, partitioned by series.
    """
    period = F.to_date(F.date_trunc(unit, col(ts))) if unit != "day" else F.to_date(col(ts))
    rows = df.where(col(ts).isNotNull())
    for s in series:
        rows = rows.where(col(s).isNotNull())
    table = (
        rows.withColumn(date, period)
        .groupBy(*[col(s) for s in series], date)
        .agg(*[F.avg(col(c)).alias(n) for n, c in means.items()], F.count("*").alias(count))
    )
    if not keep_empty:
        return table
    return fill_calendar(table, [*means, count], series, date, unit).fillna({count: 0})


def mask_low_coverage(
    daily: DataFrame, columns: Sequence[str], series: Sequence[str] = (), count: str = "n_obs",
    share: float = 0.5,
) -> DataFrame:
    """Blank the days with fewer rows than ``share`` of the median day (empty days count as 0)."""
    limit = F.median(count).over(_series_window(series)) * share
    return daily.withColumn("_limit", limit).withColumns(
        {c: F.when(F.col(count) >= F.col("_limit"), col(c)) for c in columns}
    ).drop("_limit")


def interpolate(
    daily: DataFrame, columns: Sequence[str], series: Sequence[str] = (), date: str = "date",
    drop: bool = True,
) -> DataFrame:
    """Linear in time between known values; the last value is carried on.

    Leading gaps stay NULL and, with ``drop``, leave the result. The look-ahead
    is a backward window, which costs one pass where a frame reaching forward
    to the end would cost one per row.
    """
    keys = [col(s) for s in series]
    ahead = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    back = Window.partitionBy(*keys).orderBy(date)
    day = F.unix_date(date)

    def known(c: str) -> Column:
        return F.when(col(c).isNotNull(), F.struct(day.alias("d"), col(c).alias("v")))

    nexts = daily.withColumns(
        {f"_next{i}": F.last(known(c), ignorenulls=True).over(ahead)
         for i, c in enumerate(columns)}
    )
    out = nexts.withColumns(
        {f"_prev{i}": F.last(known(c), ignorenulls=True).over(back)
         for i, c in enumerate(columns)}
    )
    filled = {}
    for i, c in enumerate(columns):
        a, z = F.col(f"_prev{i}"), F.col(f"_next{i}")
        line = a["v"] + (z["v"] - a["v"]) * ((day - a["d"]) / (z["d"] - a["d"]))
        filled[c] = F.when(col(c).isNotNull(), col(c)).when(z.isNull(), a["v"]).otherwise(line)
    out = out.withColumns(filled).select(*[col(c) for c in daily.columns])
    return out.dropna(subset=list(columns)) if drop else out


def daily_frame(
    df: DataFrame, ts: str, means: Mapping[str, str], series: Sequence[str] = (),
    coverage: bool = True,
) -> DataFrame:
    """Gap-free daily means: resample, mask thin days, interpolate."""
    daily = resample(df, ts, means, series)
    if coverage:
        daily = mask_low_coverage(daily, list(means), series)
    return interpolate(daily, list(means), series).drop("n_obs")


def to_series(daily: DataFrame, columns: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """Long form ``(series..., target, date, value)``."""
    return daily.unpivot(
        [*[col(s) for s in series], F.col("date")], [col(c) for c in columns], "target", "value"
    )


def climatology(
    daily: DataFrame, value: str, series: Sequence[str] = (), date: str = "date", reach: int = 15
) -> DataFrame:
    """Smoothed mean per day of the year: a centred moving average that wraps around."""
    keys = [col(s) for s in series]
    means = (
        daily.withColumn("day_of_year", F.dayofyear(date))
        .groupBy(*keys, "day_of_year").agg(F.avg(col(value)).alias("_mean"))
    )
    by_day = Window.partitionBy(*keys).orderBy("day_of_year")
    whole = Window.partitionBy(*keys)
    placed = means.withColumn("_p", F.row_number().over(by_day)).withColumn(
        "_n", F.count("*").over(whole)
    )
    copies = F.array(
        F.lit(0), F.when(F.col("_p") > F.col("_n") - reach, -F.col("_n")),
        F.when(F.col("_p") <= reach, F.col("_n")),
    )
    wrapped = (
        placed.withColumn("_shift", F.explode(F.array_compact(copies)))
        .withColumn("_at", F.col("_p") + F.col("_shift"))
    )
    near = Window.partitionBy(*keys).orderBy("_at").rowsBetween(-reach, reach)
    return (
        wrapped.withColumn("baseline", F.avg("_mean").over(near))
        .where(F.col("_shift") == 0)
        .select(*keys, "day_of_year", "baseline")
    )


def anomalies(
    daily: DataFrame, value: str, series: Sequence[str] = (), date: str = "date", reach: int = 15
) -> DataFrame:
    """Deviation of each day from the smoothed climatology of its series."""
    base = climatology(daily, value, series, date, reach)
    return (
        daily.withColumn("day_of_year", F.dayofyear(date))
        .join(base, [*series, "day_of_year"])
        .withColumn("anomaly", col(value) - F.col("baseline"))
    )


LAGS = (1, 2, 3, 7, 14, 21, 28)
WINDOWS = (3, 7, 14, 30)


def supervised(
    daily: DataFrame, value: str, series: Sequence[str] = (), date: str = "date",
    lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS,
) -> DataFrame:
    """One row per day with features of earlier days only, from the first day with all lags.

    A window that reaches before the first day uses the days there are.
    """
    w = Window.partitionBy(*[col(s) for s in series]).orderBy(date)
    v = col(value)
    columns = {f"lag{k}": F.lag(v, k).over(w) for k in lags}
    for n in windows:
        columns[f"rollmean{n}"] = F.avg(v).over(w.rowsBetween(-n, -1))
        columns[f"rollstd{n}"] = F.stddev_pop(v).over(w.rowsBetween(-n, -1))
    angle = F.dayofyear(date) * (2 * F.pi() / 365.25)
    columns |= {
        "month": F.month(date), "day_of_week": F.weekday(date),
        "doy_sin": F.sin(angle), "doy_cos": F.cos(angle),
    }
    rows = daily.withColumn("_r", F.row_number().over(w)).withColumns(columns)
    return rows.where(F.col("_r") > max(lags)).drop("_r")


def supervised_features(
    lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS
) -> list[str]:
    rolled = [f"{kind}{n}" for n in windows for kind in ("rollmean", "rollstd")]
    return [f"lag{k}" for k in lags] + rolled + ["month", "day_of_week", "doy_sin", "doy_cos"]


def from_end(daily: DataFrame, series: Sequence[str], date: str, name: str) -> DataFrame:
    """Position counted from the last day of each series, which is 1."""
    w = Window.partitionBy(*[col(s) for s in series]).orderBy(F.col(date).desc())
    return daily.withColumn(name, F.row_number().over(w))


def train_test(
    daily: DataFrame, test_rows: int, series: Sequence[str] = (), date: str = "date",
    name: str = "is_test",
) -> DataFrame:
    """Mark the last ``test_rows`` rows of each series as test."""
    return from_end(daily, series, date, "_e").withColumn(
        name, F.col("_e") <= test_rows
    ).drop("_e")


def tail(daily: DataFrame, rows: int, series: Sequence[str] = (), date: str = "date") -> DataFrame:
    """The last rows of each series."""
    return from_end(daily, series, date, "_e").where(F.col("_e") <= rows).drop("_e")


def classical_decomposition(
    daily: DataFrame, value: str, period: int, series: Sequence[str] = (), date: str = "date"
) -> DataFrame:
    """Additive parts: centred moving average, mean per phase (summing to 0), remainder.

    The trend is missing where the average would need days outside the series.
    """
    keys = [col(s) for s in series]
    w = Window.partitionBy(*keys).orderBy(date)
    half = period // 2
    v = col(value)
    # Moving sums are differences of running sums: one step per row and not one per day of the period.
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    running = daily.withColumns(
        {"_r": F.row_number().over(w), "_sum": F.sum(v).over(so_far), "_cnt": F.count(v).over(so_far)}
    )

    def moving(total: str, back: int, ahead: int) -> Column:
        before = F.when(F.col("_r") == back + 1, 0).otherwise(F.lag(total, back + 1).over(w))
        return F.lead(total, ahead).over(w) - before

    if period % 2:
        average, found = moving("_sum", half, half) / period, moving("_cnt", half, half)
    else:
        wide = moving("_sum", half, half - 1) + moving("_sum", half - 1, half)
        average = wide / (2 * period)
        found = F.least(moving("_cnt", half, half - 1), moving("_cnt", half - 1, half))
    parts = running.withColumns(
        {"trend": F.when(found == period, average), "_phase": F.pmod(F.col("_r") - 1, F.lit(period))}
    ).drop("_r", "_sum", "_cnt")
    # Windows over the phase and over the series give every row its seasonal part without a join;
    # each phase counts once in the mean that is taken off, however many days it has.
    phase, whole = Window.partitionBy(*keys, "_phase"), Window.partitionBy(*keys)
    share = F.when(F.col("_s").isNotNull(), 1 / F.col("_n"))
    return (
        parts.withColumn("_d", v - F.col("trend"))
        .withColumns({"_s": F.avg("_d").over(phase), "_n": F.count(F.lit(1)).over(phase)})
        .withColumn("seasonal", F.col("_s") - F.sum(F.col("_s") * share).over(whole) / F.sum(share).over(whole))
        .withColumn("resid", v - F.col("trend") - F.col("seasonal")).drop("_d", "_s", "_n", "_phase")
    )
