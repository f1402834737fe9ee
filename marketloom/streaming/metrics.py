"""Windowed request metrics on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marketloom.session import work_path

LATENESS = "10 minutes"


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def watermarked(stream: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """The stream with an event-time watermark; watermarks need the timestamp type."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def start_windows(
    stream: DataFrame, measure: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    available_now: bool = True, ts: str = "ts", lateness: str = LATENESS,
) -> StreamingQuery:
    """Run a windowed measure on a stream into a Parquet folder.

    Append mode: a window is written once, when the watermark has passed its end; later rows of it
    are dropped and counted in the progress of the query. State is one row per open window and key.
    """
    writer = (
        measure(watermarked(stream, ts, lateness))
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_windows(
    stream: DataFrame, measure: Callable[[DataFrame], DataFrame], name: str, **options
) -> DataFrame:
    """Run over everything available now and return the written windows."""
    spark = stream.sparkSession
    out, checkpoint = work_path(spark, name), work_path(spark, f"{name}-state")
    query = start_windows(stream, measure, out, checkpoint, **options)
    query.awaitTermination()
    schema = measure(stream).schema
    return spark.read.schema(schema).parquet(out)
