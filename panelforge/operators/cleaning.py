"""Cleaning: deduplicate, impute, winsorize, standardise, encode."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.binding import Binding, col
from panelforge.functions import capped, zscore
from panelforge.operators.aggregates import mode_per_column, null_counts, one_row, to_long
from panelforge.operators.filters import (
    PLAUSIBLE, Rules, drop_columns, keep_in_range, numeric_columns, require, rule_violations,
)
from panelforge.operators.quantiles import quantile_table
from panelforge.session import durable


def dedupe(df: DataFrame, b: Binding) -> DataFrame:
    """First row per key and timestamp, in the order of the tiebreak columns.

    Exact duplicates share key and timestamp, so one aggregation removes both
    kinds. It keeps a single row per group on the map side already, so many
    copies of one row never meet in a task.
    """
    names = df.columns
    same = [*b.key, b.ts]
    rest = [c for c in names if c not in same]
    order = F.struct(*[col(c) for c in (*b.tiebreak, *[r for r in rest if r not in b.tiebreak])])
    first = df.groupBy(*[col(c) for c in same]).agg(
        F.min(order).alias("_first")
    )
    return first.select(
        *[col(c) if c in same else F.col("_first")[c].alias(c) for c in names]
    )


def impute_median(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], accuracy: int | None = None,
    exact: bool = True,
) -> DataFrame:
    """Fill numbers with the median of their series, then with the median over all rows.

    The second median is taken after the first fill. Both tables of medians are
    small next to the rows and written down as they are found, so that later
    steps do not compute them again.
    """
    medians = durable(quantile_table(
        df, keys, {f"_m{i}": (col(c), 0.5) for i, c in enumerate(columns)}, accuracy, exact
    ))
    filled = df.join(medians, list(keys), "left").withColumns(
        {c: F.coalesce(col(c), F.col(f"_m{i}")) for i, c in enumerate(columns)}
    ).select(*[col(c) for c in df.columns])
    overall = durable(quantile_table(
        filled, [], {f"_m{i}": (col(c), 0.5) for i, c in enumerate(columns)}, accuracy, exact
    ))
    m = overall.select(F.struct(*[F.col(f"_m{i}") for i in range(len(columns))])).scalar()
    return filled.withColumns(
        {c: F.coalesce(col(c), m[f"_m{i}"]) for i, c in enumerate(columns)}
    )


def impute_mode(
    df: DataFrame, columns: Sequence[str], fallback: str = "Unknown", cut: bool = True
) -> DataFrame:
    """Fill text with the most frequent value of its column."""
    modes = mode_per_column(df, columns)
    modes = durable(modes) if cut else modes
    found = one_row(
        modes, *[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(f"m{i}")
                 for i, c in enumerate(columns)]
    )
    return df.withColumns(
        {c: F.coalesce(col(c), found[f"m{i}"], F.lit(fallback)) for i, c in enumerate(columns)}
    )


def winsor_bounds(
    df: DataFrame, columns: Sequence[str], multiplier: float = 3.0,
    hard: Mapping[str, tuple[float, float]] = PLAUSIBLE, tail: float = 0.001,
    accuracy: int | None = None, exact: bool = True,
) -> DataFrame:
    """Fences of each column as one row: ``low_<i>`` and ``high_<i>``.

    The fence lies ``multiplier`` IQRs outside the quartiles, at least as far
    out as the tail quantiles, and inside the hard limits. Without a spread
    between the quartiles there is no fence (NULL).
    """
    wanted = {}
    for i, c in enumerate(columns):
        for name, p in (("q1", 0.25), ("q3", 0.75), ("lo", tail), ("hi", 1 - tail)):
            wanted[f"{name}_{i}"] = (col(c), p)
    q = quantile_table(df, [], wanted, accuracy, exact)
    out = []
    for i, c in enumerate(columns):
        q1, q3 = F.col(f"q1_{i}"), F.col(f"q3_{i}")
        reach = (q3 - q1) * multiplier
        low = F.least(q1 - reach, F.col(f"lo_{i}"))
        high = F.greatest(q3 + reach, F.col(f"hi_{i}"))
        if c in hard:
            low, high = F.greatest(low, F.lit(hard[c][0])), F.least(high, F.lit(hard[c][1]))
        out.append(F.when(q3 > q1, low).alias(f"low_{i}"))
        out.append(F.when(q3 > q1, high).alias(f"high_{i}"))
    return q.select(*out)


def _fences(df: DataFrame, columns: Sequence[str], cut: bool, fences: Mapping) -> Column:
    table = winsor_bounds(df, columns, **fences)
    table = durable(table) if cut else table
    return table.select(F.struct(*[F.col(c) for c in table.columns])).scalar()


def winsorize(df: DataFrame, columns: Sequence[str], cut: bool = True, **fences) -> DataFrame:
    """Pull values outside the fences of their column back to the fence."""
    at = _fences(df, columns, cut, fences)
    return df.withColumns(
        {c: capped(col(c), at[f"low_{i}"], at[f"high_{i}"]) for i, c in enumerate(columns)}
    )


def capped_counts(df: DataFrame, columns: Sequence[str], cut: bool = True, **fences) -> DataFrame:
    """Number of values that :func:`winsorize` changes, per column."""
    at = _fences(df, columns, cut, fences)
    return to_long(
        df,
        {c: F.count_if((col(c) < at[f"low_{i}"]) | (col(c) > at[f"high_{i}"]))
         for i, c in enumerate(columns)},
        "column", "capped",
    )


def scaling_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column, kept so that scaling can be undone."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.avg(col(c)).alias("mean"),
                 F.stddev_pop(col(c)).alias("std"))
        for c in columns
    ]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def standardize(
    df: DataFrame, columns: Sequence[str] | None = None,
    keep: Sequence[str] = ("latitude", "longitude"),
) -> DataFrame:
    """Z-scores with the population deviation; all numeric columns but ``keep`` by default."""
    picked = list(columns) if columns is not None else numeric_columns(df, keep)
    stats = one_row(
        df,
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(picked)],
        *[F.stddev_pop(col(c)).alias(f"s{i}") for i, c in enumerate(picked)],
    )
    return df.withColumns(
        {c: zscore(col(c), stats[f"m{i}"], stats[f"s{i}"]) for i, c in enumerate(picked)}
    )


def unstandardize(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Undo :func:`standardize` with the table that :func:`scaling_stats` gave before it."""
    at = one_row(
        stats,
        *[F.max(F.when(F.col("column") == c, F.col("mean"))).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.max(F.when(F.col("column") == c, F.col("std"))).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    return df.withColumns({
        c: col(c) * F.when(at[f"s{i}"] > 0, at[f"s{i}"]).otherwise(F.lit(1.0)) + at[f"m{i}"]
        for i, c in enumerate(columns)
    })


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Codes 0..n-1 of the distinct labels in lexicographic order: ``(label, code)``.

    The labels are sorted in parallel ranges. The ranges are written down once,
    because a second run of the sort may cut them elsewhere; a code is then the
    rank inside the range plus the labels of all earlier ranges.
    """
    labels = df.select(F.coalesce(col(column).cast("string"), F.lit("nan")).alias("label"))
    ranges = labels.distinct().repartitionByRange("label")
    parts = durable(ranges.withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part")  # one row per range
    before = sizes.select("_part", (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("label")
    return (
        parts.withColumn("_r", F.row_number().over(inside))
        .join(before, "_part")
        .select("label", (F.col("_before") + F.col("_r") - 1).cast("int").alias("code"))
    )


def encode_labels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_encoded`` for each column."""
    for c in columns:
        codes = durable(label_codes(df, c).withColumnRenamed("code", f"{c}_encoded"))
        text = F.coalesce(col(c).cast("string"), F.lit("nan"))
        df = df.withColumn("label", text).join(codes, "label", "left").drop("label")
    return df


def decode_labels(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """Put the labels of :func:`label_codes` back for ``<column>_encoded``; a missing label was coded as ``nan``."""
    names = codes.select(F.col("code").alias("_code"), F.col("label").alias("_label"))
    joined = df.join(names, col(f"{column}_encoded") == F.col("_code"), "left").drop("_code")
    return joined.withColumn(column, F.col("_label")).drop("_label")


def scaled_table(
    df: DataFrame, columns: Sequence[str], categories: Sequence[str], carry: Sequence[str]
) -> DataFrame:
    """ML-ready table: standardised numbers, ``carry`` as it is, encoded categories."""
    encoded = encode_labels(standardize(df, columns), categories)
    return encoded.select(
        *[col(c) for c in columns], *[col(c) for c in carry],
        *[col(f"{c}_encoded") for c in categories],
    )


def clean_panel(
    df: DataFrame, b: Binding, numeric: Sequence[str], text: Sequence[str],
    required: Sequence[str], cap: Sequence[str], rules: Rules = PLAUSIBLE,
    drop: Sequence[str] = (), multiplier: float = 3.0, cut: bool = True,
) -> DataFrame:
    """All cleaning steps in order: drop, dedupe, validate, require, impute, winsorize.

    Every statistic needs a pass over the valid rows before the next step can
    use it. ``cut`` writes these rows down once, after the costly deduplication,
    and the small statistics as they are found; each pass is then one scan.
    """
    rows = dedupe(drop_columns(df, drop), b)
    rows = require(keep_in_range(rows, rules), required)
    if cut:
        rows = durable(rows)
    rows = impute_mode(impute_median(rows, b.key, numeric), text, cut=cut)
    return winsorize(rows, cap, cut=cut, multiplier=multiplier, hard=rules)


def cleaning_report(
    df: DataFrame, b: Binding, required: Sequence[str], cap: Sequence[str],
    numeric: Sequence[str], text: Sequence[str], rules: Rules = PLAUSIBLE,
    multiplier: float = 3.0,
) -> DataFrame:
    """Row counts before and after each step and per-column counts: ``(step, item, n)``."""
    unique = durable(dedupe(df, b))
    valid = keep_in_range(unique, rules)
    present = require(valid, required)
    filled = impute_mode(impute_median(present, b.key, numeric), text)

    def total(frame: DataFrame, step: str) -> DataFrame:
        return frame.agg(F.count("*").alias("n")).select(
            F.lit(step).alias("step"), F.lit("rows").alias("item"), "n"
        )

    def listed(frame: DataFrame, step: str, item: str, n: str) -> DataFrame:
        return frame.select(F.lit(step).alias("step"), F.col(item).alias("item"),
                            F.col(n).alias("n"))

    parts = [
        total(df, "raw"), total(unique, "deduplicated"), total(valid, "in_range"),
        total(present, "clean"),
        listed(rule_violations(unique, rules), "violations", "rule", "violations"),
        listed(null_counts(present), "missing", "column", "missing"),
        listed(
            capped_counts(filled, cap, multiplier=multiplier, hard=rules),
            "capped", "column", "capped",
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
