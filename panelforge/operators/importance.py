"""Feature importance: by permutation and by Shapley values of trees."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from panelforge.binding import col
from panelforge.operators.aggregates import regression_metrics
from panelforge.operators.boost import Boosted
from panelforge.operators.forest import bins_of, unpacked_bins
from panelforge.operators.sampling import hash_sample
from panelforge.operators.trees import node_table
from panelforge.session import durable, spread

BUCKET_ROWS = 10_000
MOST_PLAYERS = 8


def permutation_importance(
    model, rows: DataFrame, ids: Sequence[str], features: Sequence[str], repeats: int = 5,
    most: int | None = None, seed: int = 42,
) -> DataFrame:
    """Loss of R2 when one feature is shuffled, averaged over ``repeats``.

    ``rows`` has ``features`` (vector) and ``label``. Values are exchanged
    inside hash buckets of about 10,000 rows, by joining two random orders of
    a bucket, so no task sees more than a bucket. Each row has one donor per
    repeat, from which every feature in turn takes its value after the join.
    ``most`` asks for a hash sample of the rows.
    """
    names = list(features)
    used = rows if most is None else hash_sample(rows, ids, most, seed)
    used = used.select(
        *[col(c) for c in ids], "label", vector_to_array("features").alias("_x")
    )
    total = used.agg(F.count("*")).scalar()
    buckets = F.ceil(total / BUCKET_ROWS)
    base_id = [col(c) for c in ids]
    spread = used.withColumn("_b", F.pmod(F.xxhash64(*base_id, F.lit(seed)), buckets))
    tried = spread.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    group = Window.partitionBy("_t", "_b")
    drawn = group.orderBy(F.xxhash64(*base_id, F.col("_t"), F.lit(seed + 1)), *base_id)
    placed = tried.withColumns(
        {"_i": F.row_number().over(group.orderBy(*base_id)), "_j": F.row_number().over(drawn)}
    )
    donors = placed.select("_t", "_b", F.col("_j").alias("_i"), F.col("_x").alias("_y"))
    each = F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1)))
    swapped = placed.drop("_j").join(donors, ["_t", "_b", "_i"]).withColumn("_f", each).withColumn(
        "_x", F.transform("_x", lambda x, k: F.when(k == F.col("_f"), F.col("_y")[k]).otherwise(x))
    )
    scored = model.transform(swapped.withColumn("features", array_to_vector("_x")))
    shuffled = regression_metrics(scored, ["_f", "_t"], "label", "prediction")
    plain = model.transform(used.withColumn("features", array_to_vector("_x")))
    base = regression_metrics(plain, [], "label", "prediction").select("r2").scalar()
    labels = F.array(*[F.lit(n) for n in names])
    return (
        shuffled.withColumn("feature", labels[F.col("_f")])
        .withColumn("_loss", base - F.col("r2"))
        .groupBy("feature").agg(F.avg("_loss").alias("importance"), F.stddev_pop("_loss").alias("spread"))
        .orderBy(F.desc("importance"), "feature")
    )


def leaf_paths(nodes: pd.DataFrame) -> list[tuple]:
    """For each leaf: value times tree weight, and per feature of its path the closed range
    of values that stay on the path and the share of training rows that did."""
    paths = []
    for _, tree in nodes.groupby("tree"):
        table = tree.set_index("node").to_dict("index")

        def walk(at: int, ranges: dict[int, tuple[float, float, float]]):
            n = table[at]
            if n["left"] < 0:
                items = list(ranges.items())
                paths.append((n["value"] * n["weight"], items))
                return
            f, cut = int(n["feature"]), n["threshold"]
            low, high, share = ranges.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((n["left"], (low, min(high, cut))), (n["right"], (max(low, cut), high))):
                part = table[child]["cover"] / n["cover"]
                walk(int(child), {**ranges, f: (*bounds, share * part)})

        walk(0, {})
    return paths


def shap_values(
    model, rows: DataFrame, features: Sequence[str], name: str = "shap", base: str = "base_value",
    partitions: int | None = None,
) -> DataFrame:
    """Path-dependent Shapley values of a tree ensemble (Lundberg et al., 2020).

    Adds an array with one value per feature and the base value; together they
    sum up to the prediction. A leaf contributes through the features on its
    path only, so its part is looked up in a table by the set of features that a
    row agrees with. The tables are broadcast: their size follows from the
    number and depth of the trees. ``partitions`` deals a short
    table out to so many tasks first. Rows that agree in all bins of a
    :class:`Boosted` model have equal values, which are found once for all of
    them; a null vector has null.
    """
    spark = rows.sparkSession
    nodes = model.nodes(spark) if isinstance(model, Boosted) else node_table(model, spark)
    paths = leaf_paths(nodes.toPandas())
    tables = [(*path_table(value, items), items) for value, items in paths if items and value]
    width = len(features)
    expected = sum(v * math.prod(share for _, (_, _, share) in items) for v, items in paths)
    if isinstance(model, Boosted):
        return _by_bins(rows, model.cuts, tables, name, partitions).withColumn(base, F.lit(float(expected)))
    shared = spark.sparkContext.broadcast(tables)

    @F.pandas_udf("array<double>")
    def explain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy())
            phi = np.zeros((len(x), width))
            for on, off, items in shared.value:
                _add_leaf(phi, x, on, off, items)
            yield pd.Series(list(phi))

    return spread(rows, partitions).withColumn(name, explain(vector_to_array("features"))).withColumn(
        base, F.lit(float(expected))
    )


def _by_bins(rows: DataFrame, cuts: list[np.ndarray], tables: list, name: str, partitions: int | None) -> DataFrame:
    """``rows`` with the Shapley values of their bins; each row of bins is explained once."""
    spark, width = rows.sparkSession, len(cuts)

    # Of each leaf: the value by set, and for each feature of its path by bin whether that stays on it.
    leaves = []
    for table, shares, items in tables:
        on = []
        for f, (low, high, _) in items:
            first, last = [(0 if v < 0 else len(cuts[f])) if np.isinf(v) else int(np.searchsorted(cuts[f], v)) + d for v, d in ((low, 1), (high, 0))]
            at = np.arange(len(cuts[f]) + 1)
            on.append((at >= first) & (at <= last))
        if table.ndim > 1:
            on = [o.astype(np.uint8) << j for j, o in enumerate(on)]
            table = np.ascontiguousarray(table.T)
        leaves.append((table, shares, [f for f, _ in items], on))
    shared = spark.sparkContext.broadcast(leaves)

    @F.arrow_udf("array<double>")
    def explain(each: pa.Array) -> pa.Array:
        at = [np.ascontiguousarray(b, dtype=np.intp) for b in unpacked_bins(each, width)]
        phi = np.zeros((width, len(each)))
        for table, shares, path, on in shared.value:
            if table.ndim == 1:
                _add_long_path(phi.T, float(table[0]), shares, [o[at[f]] for o, f in zip(on, path)], path)
                continue
            number = np.zeros(len(each), np.uint8)
            for o, f in zip(on, path):
                number |= o[at[f]]
            number = number.astype(np.intp)
            for values, f in zip(table, path):
                phi[f] += values[number]
        return pa.ListArray.from_arrays(np.arange(len(each) + 1, dtype=np.int32) * width, phi.T.ravel())

    marked = rows.withColumn("_bins", bins_of(cuts)(F.when(F.col("features").isNotNull(), vector_to_array("features"))))
    each = marked.where("_bins is not null").select("_bins").distinct()
    # Few bytes, long work: a given number of tasks.
    tasks = partitions or 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = durable(spread(each, tasks).withColumn(name, explain("_bins")))
    return marked.join(found, "_bins", "left").select(*rows.columns, name)


def path_table(value: float, items: list) -> tuple[np.ndarray, np.ndarray]:
    """What a leaf adds to each feature of its path, by the set of features whose values stay on the path.

    The game of one leaf has as many players as its path has features, m, and
    a row takes part only by the set of those that it agrees with, a number of
    m bits. Both halves of a player's difference are kept, for the sets with
    and without it, in one table of 2^m sets: ``table[set, player]``. Paths
    that are too long for a table keep their value and the shares.
    """
    m = len(items)
    shares = np.array([share for _, (_, _, share) in items])
    if m > MOST_PLAYERS:
        return np.array([value]), shares
    sets = np.arange(1 << m)
    on = (sets[:, None] >> np.arange(m)) & 1
    weight = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
    table = np.zeros((1 << m, m))
    for i in range(m):
        # Sum over subsets of the others: their factors as a polynomial in the number of members.
        poly = np.zeros((1 << m, m))
        poly[:, 0] = 1.0
        for j in (k for k in range(m) if k != i):
            shifted = np.zeros_like(poly)
            shifted[:, 1:] = poly[:, :-1]
            poly = poly * shares[j] + shifted * on[:, j : j + 1]
        table[:, i] = value * (on[:, i] - shares[i]) * (poly @ weight)
    return table, shares


def _add_leaf(phi: np.ndarray, x: np.ndarray, table: np.ndarray, shares: np.ndarray, items: list) -> None:
    m = len(items)
    on = [(x[:, f] > low) & (x[:, f] <= high) for f, (low, high, _) in items]
    if table.ndim == 1:
        _add_long_path(phi, float(table[0]), shares, on, [f for f, _ in items])
        return
    number = np.zeros(len(x), np.int64)
    for j in range(m):
        number += on[j].astype(np.int64) << j
    for j, (f, _) in enumerate(items):
        phi[:, f] += table[number, j]


def _add_long_path(phi: np.ndarray, value: float, shares: np.ndarray, on: list, features: list[int]) -> None:
    m = len(on)
    weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
    # Coefficient k: sum over subsets of k features that follow the row.
    poly = [np.ones(len(phi))] + [np.zeros(len(phi)) for _ in range(m)]
    for j, z in enumerate(shares):
        for k in range(j + 1, 0, -1):
            poly[k] = poly[k] * z + poly[k - 1] * on[j]
        poly[0] = poly[0] * z
    off_total = sum(w * p for w, p in zip(weight, poly))
    for i, (f, share) in enumerate(zip(features, shares)):
        # The polynomial of the others: divide out this feature, from the highest coefficient down.
        rest = poly[m]
        on_total = weight[m - 1] * rest
        for k in range(m - 1, 0, -1):
            rest = poly[k] - share * rest
            on_total = on_total + weight[k - 1] * rest
        total = np.where(on[i], on_total, off_total / share)
        phi[:, f] += value * (on[i] - share) * total


def shap_importance(explained: DataFrame, features: Sequence[str], name: str = "shap") -> DataFrame:
    """Mean absolute Shapley value per feature, the largest first."""
    labels = F.array(*[F.lit(f) for f in features])
    return (
        explained.select(F.posexplode(name).alias("_i", "_phi"))
        .groupBy("_i").agg(F.avg(F.abs("_phi")).alias("importance"))
        .select(F.element_at(labels, F.col("_i") + 1).alias("feature"), "importance")
        .orderBy(F.desc("importance"), "feature")
    )


def shap_dependence(explained: DataFrame, feature_index: int, name: str = "shap") -> DataFrame:
    """Value of a feature and its Shapley value on every row."""
    return explained.select(
        vector_to_array("features")[feature_index].alias("value"),
        F.col(name)[feature_index].alias("shap_value"),
    )
