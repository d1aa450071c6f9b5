"""Grouped summaries. All but the quantiles are two-phase hash aggregates.

Rows with a missing group key belong to no group and are left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.binding import Binding, col
from panelforge.functions import line_p_value, regression_metric_columns, width_bin, zscore
from panelforge.operators.quantiles import exact_quantiles, long_values, quantile_table
from panelforge.session import durable


def one_row(df: DataFrame, *columns: Column) -> Column:
    """A one-row aggregate as a struct, usable inside any expression.

    Spark runs it as a scalar subquery, so no join is needed to use it.
    """
    return df.agg(F.struct(*columns).alias("_s")).scalar()


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.where(col(k).isNotNull())
    return df


def grouped(df: DataFrame, keys: Sequence[str]):
    return keyed(df, keys).groupBy(*[col(k) for k in keys])


def kpis(
    df: DataFrame, distinct: Mapping[str, str], means: Mapping[str, str], rows: str = "n_rows",
    approximate: bool = False,
) -> DataFrame:
    """Row count, distinct counts and means in one row."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(
        F.count("*").alias(rows),
        *[count(col(c)).alias(name) for name, c in distinct.items()],
        *[F.avg(col(c)).alias(name) for name, c in means.items()],
    )


def group_means(
    df: DataFrame, keys: Sequence[str], means: Mapping[str, str], count: str | None = None,
    least: int = 0,
) -> DataFrame:
    """Means per group, and the group size; groups below ``least`` rows are left out."""
    out = grouped(df, keys).agg(
        *[F.avg(col(c)).alias(name) for name, c in means.items()], F.count("*").alias("_n")
    )
    if least:
        out = out.where(F.col("_n") >= least)
    return out.withColumnRenamed("_n", count) if count else out.drop("_n")


def reindex(table: DataFrame, key: str, order: Sequence, fill: Mapping | None = None) -> DataFrame:
    """The listed groups in the listed order; groups without a row show up empty."""
    kind = dict(table.dtypes)[key]
    listed = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(v).cast(kind).alias(key))
          for i, v in enumerate(order)]
    )
    spine = table.sparkSession.range(1).select(F.inline(listed))
    out = spine.join(table, key, "left")
    return out.fillna(dict(fill)) if fill else out


def mean_of_means(df: DataFrame, outer: str, inner: str, means: Mapping[str, str]) -> DataFrame:
    """Mean over ``outer`` of the means per ``(outer, inner)``, so every inner group weighs the same."""
    per_inner = group_means(df, [outer, inner], means)
    return per_inner.groupBy(col(outer)).agg(*[F.avg(col(name)).alias(name) for name in means])


def common_values(df: DataFrame, value: str, across: str) -> DataFrame:
    """Values that occur together with every value of ``across``."""
    pairs = keyed(df, [value, across]).select(col(value), col(across)).distinct()
    everywhere = pairs.agg(F.count_distinct(col(across))).scalar()
    return (
        pairs.groupBy(col(value)).agg(F.count("*").alias("_n"))
        .where(F.col("_n") == everywhere)
        .select(col(value))
    )


def category_share(
    df: DataFrame, label: Column, categories: Sequence[str], name: str = "category",
    share: str = "share_pct",
) -> DataFrame:
    """Share in percent of each listed category among the rows of all listed categories."""
    counts = df.select(label.alias(name)).groupBy(name).agg(F.count("*").alias("_n"))
    full = reindex(counts, name, categories, {"_n": 0})
    total = counts.where(F.col(name).isin(*categories)).agg(F.sum("_n")).scalar()
    return full.select("position", name, (F.col("_n") / total * 100.0).alias(share))


def top_values(
    df: DataFrame, column: str, k: int, trim: bool = True, name: str = "n"
) -> DataFrame:
    """The ``k`` most frequent values; ties go to the smaller label."""
    value = F.trim(col(column)) if trim else col(column)
    return (
        df.select(value.alias(column)).where(col(column).isNotNull())
        .groupBy(col(column)).agg(F.count("*").alias(name))
        .orderBy(F.col(name).desc(), col(column)).limit(k)
    )


def mode_per_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value of each text column; ties go to the smallest value."""
    pairs = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value"))
             for c in columns]
    counts = (
        df.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.column", "_p.value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count("*").alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("value").alias("mode")))
    return counts.groupBy("column").agg(best.alias("_b")).select(
        "column", "_b.mode", (-F.col("_b.minus_n")).alias("n")
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values of each column: ``(column, missing)``."""
    return to_long(
        df, {c: F.count_if(col(c).isNull()) for c in df.columns}, "column", "missing"
    )


def to_long(df: DataFrame, aggregates: Mapping[str, Column], name: str, value: str) -> DataFrame:
    """Global aggregates as rows ``(name, value)``."""
    one = df.agg(
        F.array(
            *[F.struct(F.lit(k).alias(name), v.alias(value)) for k, v in aggregates.items()]
        ).alias("_rows")
    )
    return one.select(F.inline("_rows"))


def group_summary(
    df: DataFrame, b: Binding, key: str, means: Mapping[str, str], least: int,
    first: Mapping[str, str] | None = None, medians: Mapping[str, str] | None = None,
    count: str = "observations",
) -> DataFrame:
    """One row per group: first values, medians, means and row count, with a minimum support.

    ``first`` takes the first non-missing value in the order of the binding.
    Medians come from :func:`quantile_table`, for groups of any size.
    """
    medians = medians or {}
    when = F.struct(*[col(c) for c in (b.ts, *b.tiebreak)])
    out = grouped(df, [key]).agg(
        *[
            F.min_by(col(c), F.when(col(c).isNotNull(), when)).alias(name)
            for name, c in (first or {}).items()
        ],
        *[F.avg(col(c)).alias(name) for name, c in means.items()],
        F.count("*").alias(count),
    ).where(F.col(count) >= least)
    if not medians:
        return out
    middle = quantile_table(df, [key], {n: (col(c), 0.5) for n, c in medians.items()})
    return out.join(middle, key, "left")


def ranking(
    df: DataFrame, key: str, column: str, k: int, least: int = 0, largest: bool = True,
    name: str = "mean", count: str = "n",
) -> DataFrame:
    """The ``k`` groups with the largest (or smallest) mean; ties go to the smaller key."""
    table = group_means(df, [key], {name: column}, count, least)
    order = F.col(name).desc_nulls_last() if largest else F.col(name).asc_nulls_last()
    return table.orderBy(order, col(key)).limit(k)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one row per column."""
    measures = {c: col(c) for c in columns}
    moments = long_values(df, [], measures).groupBy("measure").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = exact_quantiles(df, [], measures, [0.25, 0.5, 0.75])
    quartiles = q.groupBy("measure").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
          for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
    )
    return moments.join(quartiles, "measure").withColumnRenamed("measure", "column")


def correlations(
    df: DataFrame, rows: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Pearson correlations ``(row, column, r)`` over pairwise complete rows, in one scan.

    Without ``columns`` the whole symmetric matrix of ``rows`` is built, each
    pair being computed once.
    """
    if columns is None:
        found = to_pairs(df, [(a, c) for i, a in enumerate(rows) for c in rows[i:]], mirror=True)
        return found
    return to_pairs(df, [(a, c) for a in rows for c in columns])


def to_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], mirror: bool = False) -> DataFrame:
    """Correlations of the pairs in one aggregate; ``mirror`` gives (b, a) the value of (a, b) too."""
    cells = []
    for a, c in pairs:
        r = F.corr(col(a), col(c)).alias("r")
        cells.append(F.struct(F.lit(a).alias("row"), F.lit(c).alias("column"), r))
        if mirror and a != c:
            cells.append(F.struct(F.lit(c).alias("row"), F.lit(a).alias("column"), r))
    return df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum, empty bins included."""
    values = df.select(col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    ends = one_row(values, F.min("_v").alias("low"), F.max("_v").alias("high"))
    low, high = ends["low"], ends["high"]
    counts = (
        values.select(width_bin(F.col("_v"), low, high, bins).alias("bin"))
        .groupBy("bin").agg(F.count("*").alias("n"))
    )
    width = (high - low) / bins
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select(
        "bin", (low + F.col("bin") * width).alias("left_edge"),
        (low + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def box_stats(df: DataFrame, key: str, column: str, reach: float = 1.5) -> DataFrame:
    """Quartiles of each group, and whiskers at the last values within the fences."""
    c = col(column)
    quartiles = quantile_table(
        df, [key], {"q1": (c, 0.25), "median": (c, 0.5), "q3": (c, 0.75)}
    )
    iqr = F.col("q3") - F.col("q1")
    inside = c.between(F.col("q1") - reach * iqr, F.col("q3") + reach * iqr)
    return (
        keyed(df, [key]).select(col(key), c).join(durable(quartiles), key)
        .groupBy(col(key), "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, c)).alias("whisker_low"),
            F.max(F.when(inside, c)).alias("whisker_high"),
            F.count(c).alias("n"),
        )
    )


def binned_means(df: DataFrame, band: Column, column: str, name: str = "band") -> DataFrame:
    """Mean of a column per bin; rows in no bin are left out."""
    return (
        df.select(band.alias(name), col(column).alias("_v")).where(F.col(name).isNotNull())
        .groupBy(name).agg(F.avg("_v").alias("mean"), F.count("*").alias("n"))
    )


def pivot_means(
    df: DataFrame, rows: Sequence[str], across: str, values: Sequence, column: str
) -> DataFrame:
    """Means with one column per listed value of ``across``; a single aggregation."""
    return grouped(df, rows).pivot(across, list(values)).agg(F.avg(col(column)))


def extremes(df: DataFrame, value: str, label: str) -> DataFrame:
    """Largest and smallest value with their labels; ties go to the smaller label."""
    rows = df.where(col(value).isNotNull())
    top = F.struct((-col(value)).alias("v"), col(label).alias("at"))
    low = F.struct(col(value).alias("v"), col(label).alias("at"))
    one = rows.agg(F.min(top).alias("_top"), F.min(low).alias("_low"))
    listed = F.array(
        F.struct(F.lit("max").alias("kind"), F.col("_top.at").alias(label),
                 (-F.col("_top.v")).alias(value)),
        F.struct(F.lit("min").alias("kind"), F.col("_low.at").alias(label),
                 F.col("_low.v").alias(value)),
    )
    return one.select(F.inline(listed))


def bounds(df: DataFrame, ts: str) -> DataFrame:
    day = F.to_date(col(ts))
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def picklist(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """Sorted distinct values, optionally of the rows matching an earlier choice."""
    rows = df if where is None else df.where(where)
    return keyed(rows, [column]).select(col(column)).distinct().orderBy(col(column))


def regression_metrics(
    df: DataFrame, keys: Sequence[str], actual: str = "y_true", predicted: str = "y_pred"
) -> DataFrame:
    """MAE, RMSE, MAPE and R2 per group."""
    rows = df.where(col(actual).isNotNull() & col(predicted).isNotNull())
    metrics = regression_metric_columns(col(actual), col(predicted))
    return grouped(rows, keys).agg(
        *[m.alias(name) for name, m in metrics.items()], F.count("*").alias("n")
    )


def metrics_long(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metric rows ``(keys..., metric, value)``."""
    names = ["mae", "rmse", "mape", "r2"]
    return table.unpivot([col(k) for k in keys], names, "metric", "value")


def linear_trend(
    df: DataFrame, keys: Sequence[str], y: str, x: Column, per: float = 365.25
) -> DataFrame:
    """Least-squares line per group: slope, slope per ``per`` units of x, R2 and p-value."""
    rows = keyed(df, keys).select(
        *[col(k) for k in keys], col(y).cast("double").alias("_y"), x.cast("double").alias("_x")
    )
    fit = rows.groupBy(*[col(k) for k in keys]).agg(
        F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r2"), F.regr_count("_y", "_x").alias("n"),
    )
    return fit.withColumns(
        {"slope_per_year": F.col("slope") * per, "p_value": line_p_value(F.col("r2"), F.col("n"))}
    )


def quadratic_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Coefficients of ``y = c2 x^2 + c1 x + c0`` by least squares, and the range of x.

    One pass centres x, a second sums the powers; the 3x3 system is solved in closed form.
    """
    rows = df.select(col(x).cast("double").alias("_x"), col(y).cast("double").alias("_y"))
    rows = rows.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    middle = rows.agg(F.avg("_x")).scalar()
    u = F.col("_x") - middle
    sums = rows.select("_y", "_x", u.alias("_u")).agg(
        F.count("*").cast("double").alias("n"),
        *[F.sum(F.pow("_u", F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)],
        *[F.sum(F.pow("_u", F.lit(k)) * F.col("_y")).alias(f"t{k}") for k in (0, 1, 2)],
        F.min("_x").alias("x_min"), F.max("_x").alias("x_max"), F.avg("_x").alias("m"),
    )
    n, s1, s2, s3, s4 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4"))
    t0, t1, t2 = (F.col(c) for c in ("t0", "t1", "t2"))

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    d = det(n, s1, s2, s1, s2, s3, s2, s3, s4)
    a0 = det(t0, s1, s2, t1, s2, s3, t2, s3, s4) / d
    a1 = det(n, t0, s2, s1, t1, s3, s2, t2, s4) / d
    a2 = det(n, s1, t0, s1, s2, t1, s2, s3, t2) / d
    m = F.col("m")
    solved = sums.select(
        a0.alias("a0"), a1.alias("a1"), a2.alias("a2"), "m", "x_min", "x_max"
    )
    return solved.select(
        F.col("a2").alias("c2"), (F.col("a1") - 2 * F.col("a2") * m).alias("c1"),
        (F.col("a0") - F.col("a1") * m + F.col("a2") * m * m).alias("c0"), "x_min", "x_max",
    )


def quadratic_curve(fit: DataFrame, points: int = 200) -> DataFrame:
    """The fitted curve at evenly spaced points over the range of x."""
    step = (F.col("x_max") - F.col("x_min")) / (points - 1)
    at = fit.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = at.withColumn("x", F.col("x_min") + F.col("point") * step)
    x = F.col("x")
    return at.select("point", "x", (F.col("c2") * x * x + F.col("c1") * x + F.col("c0")).alias("y"))


def minmax_weight(table: DataFrame, column: str, name: str = "weight") -> DataFrame:
    """Scale to 0..1; a constant column gives 0."""
    ends = one_row(table, F.min(col(column)).alias("low"), F.max(col(column)).alias("high"))
    spread = ends["high"] - ends["low"]
    peak = F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    return table.withColumn(name, (col(column) - ends["low"]) / peak)


def cap_at_quantile(
    table: DataFrame, column: str, prob: float, name: str, accuracy: int | None = None
) -> DataFrame:
    """Cap values at a quantile of the whole column, for display scales."""
    limit = quantile_table(table, [], {"_q": (col(column), prob)}, accuracy).select("_q").scalar()
    return table.withColumn(name, F.when(col(column).isNotNull(), F.least(col(column), limit)))


def detector_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two boolean flags, and their Jaccard index."""
    both, either = col(a) & col(b), col(a) | col(b)
    out = df.agg(
        F.count("*").alias("n_samples"),
        F.count_if(col(a)).alias("flagged_a"), F.count_if(col(b)).alias("flagged_b"),
        F.count_if(both).alias("flagged_both"), F.count_if(either).alias("flagged_either"),
    )
    jaccard = F.when(
        F.col("flagged_either") > 0, F.col("flagged_both") / F.col("flagged_either")
    ).otherwise(0.0)
    return out.withColumn("jaccard", jaccard)


def flag_drivers(df: DataFrame, flag: str, columns: Sequence[str]) -> DataFrame:
    """Mean z-score of each column among the flagged rows, strongest first."""
    stats = one_row(
        df,
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(col(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    means = {
        c: F.avg(zscore(col(c), stats[f"m{i}"], stats[f"s{i}"])) for i, c in enumerate(columns)
    }
    table = to_long(df.where(col(flag)), means, "feature", "mean_z")
    return table.orderBy(F.abs("mean_z").desc(), "feature")
