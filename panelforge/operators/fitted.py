"""Fitted state as stages of an ML pipeline: fences, scaling, climatology and the isolation forest.

An estimator fits what an operator would compute from the table at hand; its
model keeps that state as small tables and applies it to any other table, for
example to the rows of a later day. Estimators and models are saved and loaded
on their own or as stages of a ``Pipeline`` or ``PipelineModel``: parameters as
metadata, tables as Parquet beside them. A table of state is bounded by the
columns, the days of the year of each series, or the parameters of the forest.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
    MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.binding import col
from panelforge.functions import capped, zscore
from panelforge.operators import anomaly, cleaning, timeseries
from panelforge.operators.aggregates import one_row
from panelforge.operators.quantiles import quantile_table
from panelforge.session import durable


class _TableWriter(MLWriter):
    def __init__(self, model: "TableModel"):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"tables": sorted(self.model.tables)})
        for name, table in self.model.tables.items():
            table.write.parquet(f"{path}/tables/{name}")


class _TableReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> "TableModel":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind({n: self.sparkSession.read.parquet(f"{path}/tables/{n}") for n in metadata["tables"]})
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class TableModel(Model, MLReadable, MLWritable):
    """A model whose state is a few small tables by name."""

    def __init__(self, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.tables = dict(tables or {})

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class _Columns(Params):
    columns = Param(Params._dummy(), "columns", "measures", TypeConverters.toListString)


class _Fit(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Parameters by name; unknown names are refused."""

    def __init__(self, **values):
        super().__init__()
        for name, value in values.items():
            self.set(self.getParam(name), value)

    def _model(self, kind: type, **tables: DataFrame) -> TableModel:
        # Written down once: the model is applied again and again.
        return self._copyValues(kind({n: durable(t) for n, t in tables.items()}))


class FenceModel(TableModel, _Columns):
    """Pulls values outside the fitted fences back to them; a missing value or fence changes nothing."""

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.getOrDefault(self.columns)
        at = one_row(self.tables["fences"], *[F.first(f"{s}_{i}").alias(f"{s}_{i}") for i in range(len(names)) for s in ("low", "high")])
        return df.withColumns({c: capped(col(c), at[f"low_{i}"], at[f"high_{i}"]) for i, c in enumerate(names)})


class Fences(_Fit, _Columns):
    """Fences of ``cleaning.winsor_bounds`` at ``multiplier`` IQRs, without hard limits."""

    multiplier = Param(Params._dummy(), "multiplier", "IQRs beyond the quartiles", TypeConverters.toFloat)

    def _fit(self, df: DataFrame) -> FenceModel:
        far = self.getOrDefault(self.multiplier) if self.isSet(self.multiplier) else 3.0
        return self._model(FenceModel, fences=cleaning.winsor_bounds(df, self.getOrDefault(self.columns), far, hard={}))


class ScalingModel(TableModel, _Columns):
    """Standardises by the fitted means and deviations; a constant column is only centred."""

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.getOrDefault(self.columns)
        own = {c: F.col("column") == c for c in names}
        at = one_row(self.tables["stats"], *[
            F.max(F.when(own[c], F.col(s))).alias(f"{s}_{i}") for i, c in enumerate(names) for s in ("mean", "std")])
        return df.withColumns({c: zscore(col(c), at[f"mean_{i}"], at[f"std_{i}"]) for i, c in enumerate(names)})


class Scaling(_Fit, _Columns):
    """Mean and population deviation of each column."""

    def _fit(self, df: DataFrame) -> ScalingModel:
        return self._model(ScalingModel, stats=cleaning.scaling_stats(df, self.getOrDefault(self.columns)))


class _Seasonal(Params):
    value = Param(Params._dummy(), "value", "measure", TypeConverters.toString)
    series = Param(Params._dummy(), "series", "columns that identify a series", TypeConverters.toListString)
    date = Param(Params._dummy(), "date", "date column", TypeConverters.toString)


class ClimatologyModel(TableModel, _Seasonal):
    """Adds ``baseline`` and ``anomaly``; both are NULL on a day of the year, or in a series, that the fit has not seen."""

    def _transform(self, df: DataFrame) -> DataFrame:
        series = self.getOrDefault(self.series)
        placed = df.withColumn("day_of_year", F.dayofyear(col(self.getOrDefault(self.date))))
        met = placed.join(self.tables["baseline"], [*series, "day_of_year"], "left")
        return met.withColumn("anomaly", col(self.getOrDefault(self.value)) - F.col("baseline"))


class Climatology(_Fit, _Seasonal):
    """Smoothed mean per day of the year of daily rows."""

    def _fit(self, df: DataFrame) -> ClimatologyModel:
        series = self.getOrDefault(self.series)
        base = timeseries.climatology(df, self.getOrDefault(self.value), series, self.getOrDefault(self.date))
        return self._model(ClimatologyModel, baseline=base.select(*[col(s) for s in series], "day_of_year", "baseline"))


class _Forest(_Columns):
    ids = Param(Params._dummy(), "ids", "columns that identify a row", TypeConverters.toListString)
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    sample = Param(Params._dummy(), "sample", "rows a tree", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of draws", TypeConverters.toInt)
    contamination = Param(Params._dummy(), "contamination", "share of fitted rows above the threshold", TypeConverters.toFloat)
    flag = Param(Params._dummy(), "flag", "name of the flag", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(trees=200, sample=256, seed=42, contamination=0.01, flag="outlier_iforest")


class IsolationForestModel(TableModel, _Forest):
    """Adds ``score`` and the flag of rows above the fitted threshold; a row with a missing measure has no score and no flag."""

    def __init__(self, tables: dict[str, DataFrame] | None = None):
        super().__init__(tables)
        self._defaults()

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        scored = anomaly.isolation_scores(df, get(self.columns), self.tables["nodes"], get(self.sample))
        limit = self.tables["threshold"].select("limit").scalar()
        return scored.withColumn(get(self.flag), F.coalesce(F.col("score") > limit, F.lit(False)))


class IsolationForest(_Fit, _Forest):
    """Trees on samples by hash, and the quantile of the scores of all fitted rows as threshold."""

    def __init__(self, **values):
        super().__init__(**values)
        self._defaults()

    def _fit(self, df: DataFrame) -> IsolationForestModel:
        get = self.getOrDefault
        columns = get(self.columns)
        nodes = durable(anomaly.fit_isolation_forest(df, get(self.ids), columns, get(self.trees), get(self.sample), get(self.seed)))
        scored = durable(anomaly.isolation_scores(df, columns, nodes, get(self.sample)).select("score"))
        limit = quantile_table(scored, [], {"limit": (F.col("score"), 1 - get(self.contamination))})
        return self._copyValues(IsolationForestModel({"nodes": nodes, "threshold": durable(limit.select("limit"))}))
