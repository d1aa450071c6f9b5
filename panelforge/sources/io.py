"""Sources and sinks. Readers give lazy DataFrames with NaN already turned into NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from panelforge.binding import col
from panelforge.functions.dates import parse_ts
from panelforge.functions.missing import nan_to_null


def read_parquet(spark: SparkSession, path: str, floats_may_be_nan: bool = False) -> DataFrame:
    """Parquet scan. Only ask for the NaN fix where a writer may have left NaN behind:
    it stands between a filter on that column and the scan."""
    df = spark.read.parquet(path)
    return nan_to_null(df) if floats_may_be_nan else df


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str, ts: Sequence[str] = (),
    fmt: str | None = None,
) -> DataFrame:
    """CSV scan with a given schema.

    Columns listed in ``ts`` are read as text and parsed leniently: text that is
    no timestamp gives NULL. Malformed fields give NULL as well.
    """
    df = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE")
    for name in ts:
        df = df.withColumn(name, parse_ts(col(name), fmt))
    return nan_to_null(df)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return nan_to_null(spark.read.schema(schema).json(path))


def write_parquet(
    df: DataFrame, path: str, sort: Sequence[str] = (), partition_by: Sequence[str] = ()
) -> str:
    """Parquet sink; ``sort`` orders the whole output, so row groups have tight bounds.

    With ``partition_by`` rows are dealt by ranges of both, so a task writes few
    partition values and the number of files does not grow with the tasks.
    """
    if partition_by:
        df = df.repartitionByRange(*[col(c) for c in partition_by], *[col(c) for c in sort])
        df = df.sortWithinPartitions(*[col(c) for c in (*partition_by, *sort)])
    elif sort:
        df = df.orderBy(*[col(c) for c in sort])
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # the default would cut to milliseconds
    writer = df.write.mode("overwrite").option("header", True)
    writer.option("timestampFormat", micros).option("timestampNTZFormat", micros).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """Report rows, one JSON object per line."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def write_model(model, path: str) -> str:
    """Save an MLlib model, or a model kept as a table (trees, coefficients)."""
    if isinstance(model, DataFrame):
        return write_parquet(model, path)
    model.write().overwrite().save(path)
    return path


def read_model(spark: SparkSession, path: str, kind=None):
    """Load what :func:`write_model` saved; ``kind`` is the MLlib model class."""
    return spark.read.parquet(path) if kind is None else kind.load(path)
