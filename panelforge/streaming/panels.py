"""Structured Streaming over a folder of observations.

State is bounded by the watermark: keys and days are forgotten once event time
is ``late`` behind the newest row of the batches before. Rows that come later
than that are left out; within it the results are those of the batch operators.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelforge.binding import Binding, col


def arrivals(spark: SparkSession, path: str, schema, ts: str, late: str, files: int | None = None) -> DataFrame:
    """The Parquet files below ``path`` as a stream, ``files`` at most in a batch; ``ts`` becomes an instant, as watermarks need."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return reader.parquet(path).withColumn(ts, col(ts).cast("timestamp")).withWatermark(ts, late)


def deduped(stream: DataFrame, b: Binding) -> DataFrame:
    """One row per key and timestamp, the first to arrive.

    Rows without a key share one. Rows without a time are told apart by their
    key in their own batch only, as no watermark bounds their state: a later
    batch may bring the same key again.
    """
    return stream.dropDuplicatesWithinWatermark([*b.key, b.ts])


def daily_means(stream: DataFrame, keys: Sequence[str], ts: str, measures: Mapping[str, Column]) -> DataFrame:
    """Row count and means per key and day, each day once it is complete: when the watermark has passed its end.

    Rows without a time belong to no day.
    """
    days = stream.groupBy(*[col(k) for k in keys], F.window(col(ts), "1 day").alias("_day")).agg(
        F.count("*").alias("n"), *[F.avg(m).alias(name) for name, m in measures.items()]
    )
    return days.select(*[col(k) for k in keys], F.col("_day.start").cast("date").alias("date"), "n", *[col(m) for m in measures])


def finished(stream: DataFrame, path: str) -> DataFrame:
    """Run the stream over all files there are, then read what it has written below ``path``.

    Progress is kept beside the rows, so that a second run goes on with the
    files that are new, and a run that was lost is taken up again.
    """
    run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/progress")
    run.trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
