"""Tree ensembles of MLlib, their node tables and their importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.binding import col
from panelforge.sources import scratch_path


# Rows keep the number of their node, so that a half-built ensemble does not travel with every task.
CACHED = {"cacheNodeIds": True, "checkpointInterval": 10, "maxMemoryInMB": 2048}


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """Feature vector; names with dots are handled by position."""
    plain = {f"_f{i}": col(c).cast("double") for i, c in enumerate(features)}
    made = VectorAssembler(inputCols=list(plain), outputCol=output).transform(df.withColumns(plain))
    return made.drop(*plain)


def forest(**params) -> RandomForestRegressor:
    """MLlib's random forest over all features, for trees that the driver can hold; :mod:`.forest` has no such bound."""
    settings = {"maxDepth": 30, "featureSubsetStrategy": "all", **CACHED, **params}
    return RandomForestRegressor(featuresCol="features", labelCol="label", **settings)


def boosting(**params) -> GBTRegressor:
    """Gradient boosting; rows and columns are sampled at 0.9 unless set otherwise.

    Many rounds need a checkpoint folder, which cuts their lineage: more than 20 without one are refused.
    """
    settings = {"subsamplingRate": 0.9, "featureSubsetStrategy": "0.9", **CACHED, **params}
    if settings.get("maxIter", 20) > 20 and SparkSession.active().sparkContext.getCheckpointDir() is None:
        raise ValueError("many rounds need a checkpoint folder: set spark.checkpoint.dir")
    return GBTRegressor(featuresCol="features", labelCol="label", **settings)


def importances(model, features: Sequence[str], spark: SparkSession, top: int | None = None) -> DataFrame:
    """Importance of each feature, the largest first."""
    values = model.featureImportances.toArray().tolist()
    table = spark.createDataFrame(list(zip(features, values)), "feature string, importance double")
    ordered = table.orderBy(F.desc("importance"), "feature")
    return ordered.limit(top) if top else ordered


def node_table(model, spark: SparkSession) -> DataFrame:
    """Nodes of the fitted trees as a table, read from the saved form of the model.

    ``(tree, weight, node, feature, threshold, left, right, value, cover)``;
    its size follows from the number and depth of the trees.
    """
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").select(
        F.col("_1").alias("treeID"), F.col("_3").alias("weight")
    )
    # A forest averages its trees, boosting adds them up.
    share = 1.0 / model.getNumTrees if isinstance(model, RandomForestRegressionModel) else 1.0
    return nodes.join(weights, "treeID").select(
        F.col("treeID").alias("tree"), (F.col("weight") * share).alias("weight"), F.col("id").alias("node"),
        F.col("split.featureIndex").alias("feature"),
        F.when(F.size("split.leftCategoriesOrThreshold") > 0,
               F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("prediction").alias("value"), F.col("rawCount").cast("double").alias("cover"),
    )
