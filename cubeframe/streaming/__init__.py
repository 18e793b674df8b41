"""Structured Streaming over frame datasets: one writer appends frames, any number of readers follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cubeframe.sources import register


def read_frames(spark: SparkSession, path: str, dataset: str, form: str = "frame", **options: object) -> DataFrame:
    """A stream of the frames that are there and that come; its offset is their number."""
    reader = register(spark).readStream.format("h5").option("path", path).option("dataset", dataset).option("form", form)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def append_frames(frames: DataFrame, path: str, dataset: str, checkpoint: str, **options: object) -> StreamingQuery:
    """Append a stream of (seq, value) to a dataset, each micro-batch in the order of ``seq``, exactly once."""
    register(frames.sparkSession)
    writer = frames.writeStream.format("h5").option("path", path).option("dataset", dataset).option("checkpointLocation", checkpoint)
    for name, value in options.items():
        writer = writer.option(name, value)
    return writer.trigger(availableNow=True).start()
