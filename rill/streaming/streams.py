"""Structured Streaming: row-wise verbs run on streams as they are; windows need an event-time column and a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F

from ..operators.frame import Frame, session
from ..plans.pipeline import Pipeline

ROWWISE = ("select", "exclude", "keep", "remove", "derive")


def read_stream(path: str, schema, files_per_batch: int | None = None) -> Frame:
    """Parquet files of a folder as they arrive."""
    reader = session().readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return Frame(reader.parquet(path))


def on_stream(pipeline: Pipeline, stream: Frame) -> Frame:
    """A pipeline of row-wise verbs over a stream."""
    for s in pipeline.steps:
        if s.kind not in ROWWISE:
            raise ValueError(f"{s.kind} does not run row by row")
    return Pipeline(None, pipeline.steps).execute(stream)


def windowed(frame: Frame, time: str, every: str, late: str, keys: tuple[str, ...] = (), value: str | None = None) -> SparkFrame:
    """Counts (and sums of a value) by window and keys; rows later than ``late`` may be dropped on a stream."""
    at = frame.sdf
    if at.isStreaming:  # watermarks need the session's time zone
        at = at.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    aggregates = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    out = at.groupBy(F.window(time, every).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("start"), *keys, *[c for c in out.columns if c in ("n", "total")])
