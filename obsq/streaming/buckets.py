"""Time buckets over a stream of events."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsq.operators.events import timeseries
from obsq.sources.tables import table_schema


def read_event_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """New files of the event table as a stream, in bounded batches if asked."""
    reader = spark.readStream.schema(table_schema("event"))
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def bucket_stream(
    events: DataFrame,
    aggregates: Sequence[Column],
    bucket: timedelta,
    late_by: timedelta,
    facets: Sequence[str | Column] = (),
) -> DataFrame:
    """Bucketed aggregates of a stream, each bucket final once ``late_by`` behind.

    State holds one row per open bucket and facet value. A watermark needs an
    instant rather than a local time, hence the cast.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark(
        "ts", f"{late_by.total_seconds():.0f} seconds"
    )
    return timeseries(timed, aggregates, bucket, facets)
