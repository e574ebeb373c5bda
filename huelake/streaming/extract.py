"""Dominant colours of a stream of frames. Frames are independent, so there is no state and no watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..functions.algorithm import Algorithm
from ..operators.mmcq import extract


def extract_stream(frames: DataFrame, count: int, palette: DataFrame, algorithm: Algorithm | str | None = None) -> DataFrame:
    """A streaming DataFrame of dominants; `palette` is a static table."""
    return extract(frames, count, palette, algorithm)


def write_batches(frames: DataFrame, count: int, palette: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, algorithm: Algorithm | str | None = None) -> DataStreamWriter:
    """Extraction a micro-batch at a time, for sinks that need a whole batch and its number."""
    return frames.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(extract(df, count, palette, algorithm), n))
