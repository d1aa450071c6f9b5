"""Row windows over the series of a panel, safe for series of any length.

A window function sorts a whole series in one task. That is fine for the many
short series of a panel, but not for one that holds a third of the table.
:func:`over_series` therefore cuts series into blocks of rows, repeats the last
``back`` rows of each block in front of the next one, and runs the same window
expressions per block. The result is exactly that of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from panelforge.binding import Binding, col
from panelforge.session import durable

Exprs = Callable[[WindowSpec], dict[str, Column]]
BLOCK_ROWS = 100_000

def over_series(
    df: DataFrame, b: Binding, make: Exprs, back: int, block_rows: int | None = BLOCK_ROWS
) -> DataFrame:
    """Add the window columns ``make(window)``, which look at most ``back`` rows back.

    Every series is cut into blocks of ``block_rows`` rows, whatever its
    length. None chooses the plain window: each series sorted in one task, in a
    single pass over the input, for panels of many short series.
    Rows without a key belong to no series and get NULL; they are spread by a
    hash, so that they do not meet in one task.
    """
    keys = [col(k) for k in b.key]
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | k.isNull()
    if block_rows is None:
        place = F.xxhash64(col(b.ts), *[col(c) for c in b.tiebreak])
        window = Window.partitionBy(*keys, F.when(keyless, F.pmod(place, F.lit(4096)))).orderBy(*b.order())
        return df.withColumns({n: F.when(~keyless, c) for n, c in make(window).items()})

    blocks = _blocks(df.where(~keyless), b, back, max(block_rows, back))
    block = Window.partitionBy(*keys, "_block").orderBy("_pos")
    done = blocks.withColumns(make(block)).where(~F.col("_halo")).drop("_halo", "_pos", "_block")
    done = done.select(*[col(c) for c in df.columns], *[col(c) for c in done.columns if c not in df.columns])
    added = [f for f in done.schema.fields if f.name not in df.columns]
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in added}
    return done.unionByName(df.where(keyless).withColumns(nothing))


def _numbered(df: DataFrame, b: Binding) -> DataFrame:
    """Number the rows of each series from 0, ``_pos``.

    The table is dealt into ranges of (key, time, tiebreak) by Spark's sample
    of these columns, so the ranges hold about equally many rows, be it a long
    series, a burst or one single time that holds them. A row's number is its
    rank inside its range plus the rows of its series in all earlier ranges:
    no task sorts more than a range.
    """
    keys = [col(k) for k in b.key]
    ranged = df.repartitionByRange(*keys, *b.order()).withColumn("_range", F.spark_partition_id())
    ranged = durable(ranged)  # the cuts are drawn once
    earlier = Window.partitionBy(*keys).orderBy("_range")
    offsets = durable(
        ranged.groupBy(*keys, "_range")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(earlier) - F.col("_rows"))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*b.order())
    return (
        ranged.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*b.key, "_range"])
        .withColumn("_pos", F.col("_before") + F.col("_rank") - 1)
        .drop("_before", "_rank", "_range")
    )


def _blocks(df: DataFrame, b: Binding, back: int, block_rows: int) -> DataFrame:
    """Hand out the rows of each series to blocks, with the last rows of the block before as a halo."""
    numbered = _numbered(df, b)
    own = F.floor(F.col("_pos") / block_rows)
    needed_next = F.pmod(F.col("_pos"), F.lit(block_rows)) >= block_rows - back
    blocks = F.when(needed_next, F.array(own, own + 1)).otherwise(F.array(own))
    return (
        numbered.withColumn("_own", own)
        .withColumn("_block", F.explode(blocks))
        .withColumn("_halo", F.col("_block") != F.col("_own"))
        .drop("_own")
    )


def lags(
    df: DataFrame, b: Binding, columns: Sequence[str], steps: Sequence[int] = (1, 2, 3, 7, 14),
    block_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Earlier values of each series, ``<column>_lag<k>``."""
    return over_series(df, b, lambda w: lag_columns(w, columns, steps), max(steps), block_rows)


def lag_columns(w: WindowSpec, columns: Iterable[str], steps: Sequence[int]) -> dict[str, Column]:
    return {f"{c}_lag{k}": F.lag(col(c), k).over(w) for c in columns for k in steps}


def rolling(
    df: DataFrame, b: Binding, columns: Sequence[str],
    windows: Sequence[int] = (3, 7, 14, 30), block_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Mean and sample deviation of the rows before the current one."""
    return over_series(
        df, b, lambda w: rolling_columns(w, columns, windows), max(windows), block_rows
    )


def rolling_columns(
    w: WindowSpec, columns: Iterable[str], windows: Sequence[int]
) -> dict[str, Column]:
    """Windows count rows, leave out the current row and need half of their values."""
    out = {}
    for c in columns:
        for n in windows:
            frame = w.rowsBetween(-n, -1)
            enough = F.count(col(c)).over(frame) >= max(2, n // 2)
            out[f"{c}_rollmean{n}"] = F.when(enough, F.avg(col(c)).over(frame))
            out[f"{c}_rollstd{n}"] = F.when(enough, F.stddev_samp(col(c)).over(frame))
    return out


def difference_columns(
    w: WindowSpec, column: str, steps: dict[str, tuple[int, float]]
) -> dict[str, Column]:
    """``{name: (rows back, divisor)}``: change against an earlier row."""
    c = col(column)
    return {name: (c - F.lag(c, k).over(w)) / by for name, (k, by) in steps.items()}


def differences(
    df: DataFrame, b: Binding, column: str, steps: dict[str, tuple[int, float]],
    block_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    back = max(k for k, _ in steps.values())
    return over_series(df, b, lambda w: difference_columns(w, column, steps), back, block_rows)


def rolling_range_column(w: WindowSpec, column: str, rows: int = 7, least: int = 3) -> Column:
    """Maximum minus minimum over the current row and those just before it."""
    frame = w.rowsBetween(1 - rows, 0)
    c = col(column)
    spread = F.max(c).over(frame) - F.min(c).over(frame)
    return F.when(F.count(c).over(frame) >= least, spread)


def rolling_range(
    df: DataFrame, b: Binding, column: str, name: str, rows: int = 7, least: int = 3,
    block_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    return over_series(
        df, b, lambda w: {name: rolling_range_column(w, column, rows, least)}, rows - 1, block_rows
    )


def top_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows of each group. Spark limits each group before the shuffle."""
    w = Window.partitionBy(*[col(g) for g in groups]).orderBy(*order)
    out = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def rank_by(
    table: DataFrame, order: Sequence[Column], name: str, groups: Sequence[str] = ()
) -> DataFrame:
    """Rank, from 1, of the rows of an aggregate (one row per cluster, model, ...).

    Meant for short tables: without ``groups`` the window has one partition.
    """
    w = Window.partitionBy(*[col(g) for g in groups]).orderBy(*order)
    return table.withColumn(name, F.row_number().over(w))
