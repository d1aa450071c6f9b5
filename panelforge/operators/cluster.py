"""Clusters and projections of aggregated places."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from panelforge.binding import col
from panelforge.functions import zscore
from panelforge.operators.aggregates import group_means, one_row
from panelforge.operators.trees import assemble
from panelforge.operators.windows import rank_by
from panelforge.session import durable, side_by_side


def fill_and_scale(df: DataFrame, features: Sequence[str]) -> dict[str, Column]:
    """Standardised features with missing values at the mean, as columns ``_z<i>``."""
    means = one_row(df, *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(features)])
    filled = {c: F.coalesce(col(c), means[f"m{i}"]) for i, c in enumerate(features)}
    spread = one_row(df, *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(filled.values())])
    return {
        f"_z{i}": zscore(v, means[f"m{i}"], spread[f"s{i}"])
        for i, v in enumerate(filled.values())
    }


def kmeans(
    df: DataFrame, features: Sequence[str], k: int = 5, starts: int = 10, seed: int = 42,
    name: str = "cluster",
) -> DataFrame:
    """Cluster the rows; of ``starts`` runs the one with the lowest cost wins."""
    scaled = fill_and_scale(df, features)
    rows = durable(assemble(df.withColumns(scaled), list(scaled)).drop(*scaled))
    fits = side_by_side(
        [
            partial(KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol=name).fit, rows)
            for i in range(starts)
        ]
    )
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).drop("features")


def rank_clusters(df: DataFrame, by: str, name: str = "cluster") -> DataFrame:
    """Renumber clusters from 0 in the order of their mean of ``by``."""
    means = group_means(df, [name], {"_mean": by})
    ranks = rank_by(means, [F.asc("_mean"), col(name)], "_rank").select(
        col(name), (F.col("_rank") - 1).cast("int").alias("_rank")
    )
    out = df.join(durable(ranks), name).withColumn(name, F.col("_rank")).drop("_rank")
    return out.select(*[col(c) for c in df.columns])


def cluster_profile(df: DataFrame, means: Mapping[str, str], name: str = "cluster") -> DataFrame:
    return group_means(df, [name], means, count="n")


def pca(df: DataFrame, features: Sequence[str], k: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Add ``pc1..pck`` of the centred features; the largest loading of each is positive.

    Also returns the loadings (features x k). Rows must be complete.
    """
    rows = assemble(df, features, "_raw")
    centring = StandardScaler(withMean=True, withStd=False, inputCol="_raw", outputCol="_centred")
    centred = centring.fit(rows).transform(rows)
    model = PCA(k=k, inputCol="_centred", outputCol="_pc").fit(centred)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    scores = model.transform(centred).withColumn("_pc", vector_to_array("_pc"))
    out = scores.withColumns(
        {f"pc{j + 1}": F.col("_pc")[j] * float(signs[j]) for j in range(k)}
    )
    return out.drop("_raw", "_centred", "_pc"), loadings * signs
