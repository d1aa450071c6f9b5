"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in the memory of one
task. Here a mergeable sketch first brackets each quantile, then only the few
values inside the brackets are counted and ordered, next to the ends of the
stretches between them. The plan is the same for groups of every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.binding import col
from panelforge.session import durable

ACCURACY = 10_000


def long_values(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """One row per key and measure: ``(keys..., measure, value)`` without missing values."""
    names = list(measures)
    wide = df.select(
        *[col(k) for k in keys],
        *[c.cast("double").alias(f"_m{i}") for i, c in enumerate(measures.values())],
    )
    if len(names) == 1:
        rows = wide.select(
            *[col(k) for k in keys], F.lit(names[0]).alias("measure"), F.col("_m0").alias("value")
        )
    else:
        labels = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (f"_m{i}", n)])
        rows = wide.unpivot(
            [col(k) for k in keys], [f"_m{i}" for i in range(len(names))], "measure", "value"
        ).withColumn("measure", labels[F.col("measure")])
    return rows.where(F.col("value").isNotNull())


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column],
    probs: Sequence[float], accuracy: int = ACCURACY,
) -> DataFrame:
    """Linear-interpolated quantiles: ``(keys..., measure, prob, quantile)``."""
    rows = long_values(df, keys, measures)
    for k in keys:
        rows = rows.where(col(k).isNotNull())
    return _bracketed(rows, [*keys, "measure"], probs, accuracy)


def _bracketed(
    rows: DataFrame, names: Sequence[str], probs: Sequence[float], accuracy: int
) -> DataFrame:
    """Quantiles by brackets.

    A sketch is off by at most ``n / accuracy`` ranks, so twice that on either
    side of a quantile surely holds its neighbours, or, in a small group, ends
    next to them. The values inside these brackets are counted one by one, and
    all values between two brackets as one entry with its smallest and largest
    value; running sums over these few entries give the ranks. The query fails,
    rather than being wrong, should a bracket ever miss its quantile.
    """
    group = [col(g) for g in names]
    edges = [min(1.0, max(0.0, p + side * 2.0 / accuracy)) for p in probs for side in (-1, 1)]
    sketch = rows.groupBy(*group).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("value", edges, F.lit(accuracy)).alias("_edges"),
    )
    brackets = durable(
        sketch.select(*group, "_n", *[F.col("_edges")[i].alias(f"_e{i}") for i in range(len(edges))])
    )
    value = F.col("value")
    inside = F.lit(False)
    for i in range(len(probs)):
        inside = inside | value.between(F.col(f"_e{2 * i}"), F.col(f"_e{2 * i + 1}"))
    passed = [F.when(F.col(f"_e{i}") < value, F.col(f"_e{i}")) for i in range(2 * len(probs))]
    entry = F.when(inside, value).otherwise(F.greatest(F.lit(float("-inf")), *passed))
    counts = (
        rows.join(brackets, list(names))
        .select(*group, "_n", "value", entry.alias("_v"), (~inside).alias("_between"))
        .groupBy(*group, "_n", "_v", "_between")
        .agg(F.count("*").alias("_c"), F.min("value").alias("_first"), F.max("value").alias("_last"))
    )
    ordered = Window.partitionBy(*group).orderBy("_v", "_between")
    ranked = counts.withColumn("_upto", F.sum("_c").over(ordered))

    def at(position: Column) -> Column:
        start, end = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
        hit = (start <= position) & (position <= end)
        value = F.when(~F.col("_between"), F.col("_v")).when(position == start, F.col("_first"))
        return F.max(F.when(hit, value.when(position == end, F.col("_last"))))

    ranks = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    found = ranked.groupBy(*group, "_n").agg(
        *[at(F.floor(r)).alias(f"_lo{i}") for i, r in enumerate(ranks)],
        *[at(F.ceil(r)).alias(f"_hi{i}") for i, r in enumerate(ranks)],
    )
    missed = F.raise_error(F.lit("quantile outside its bracket; raise the accuracy")).cast("double")
    results = []
    for i, (p, r) in enumerate(zip(probs, ranks)):
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        exact = F.when(low.isNull() | high.isNull(), missed).otherwise(
            low + (high - low) * (r - F.floor(r))
        )
        results.append(F.struct(F.lit(p).alias("prob"), exact.alias("quantile")))
    return found.select(*group, F.inline(F.array(*results)))


def quantile_table(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]],
    accuracy: int | None = None, exact: bool = True,
) -> DataFrame:
    """One row per group with one column per entry ``{name: (column, probability)}``.

    ``exact=False`` trades exactness for a single pass with ``approx_percentile``.
    """
    if not exact:
        grouped = df
        for k in keys:
            grouped = grouped.where(col(k).isNotNull())
        return grouped.groupBy(*[col(k) for k in keys]).agg(
            *[
                F.percentile_approx(c.cast("double"), p, F.lit(accuracy or ACCURACY)).alias(name)
                for name, (c, p) in wanted.items()
            ]
        )
    # Quantiles of the same column share one measure.
    measures: dict[str, Column] = {}
    place = {}
    for name, (c, p) in wanted.items():
        measure = str(c)
        measures[measure] = c
        place[name] = (measure, p)
    probs = sorted({p for _, p in wanted.values()})
    found = exact_quantiles(df, keys, measures, probs, accuracy or ACCURACY)
    return found.groupBy(*[col(k) for k in keys]).agg(
        *[
            F.max(
                F.when((F.col("measure") == m) & (F.col("prob") == p), F.col("quantile"))
            ).alias(name)
            for name, (m, p) in place.items()
        ]
    )
