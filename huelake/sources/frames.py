"""Frames of packed pixels: schemas, validation, and pixel rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

RGB8 = "frame_id long, width long, height long, stride long, rgb binary"
RGB16 = "frame_id long, width long, height long, stride long, rgb16 array<int>"
U32_MAX = 4294967295
#: Bytes of 8-bit planes that are made at once.
PLANES = 1 << 24


def frame_error(width: Column, height: Column, stride: Column, length: Column) -> Column:
    """Name of the first violated rule, or null. All values are BIGINT; lengths are in bytes or, for 16 bits, in elements."""
    return (
        F.when((width == 0) | (height == 0), "ZeroDimension")
        .when(width * 3 > U32_MAX, "WidthOverflow")
        .when(stride < width * 3, "StrideTooSmall")
        .when(F.coalesce(length < F.try_multiply(stride, height), F.lit(True)), "PlaneTooShort")  # overflow: longer than any plane
    )


def _validated(frames: DataFrame, length: Column) -> DataFrame:
    w, h, s = (F.col(c).cast("long") for c in ("width", "height", "stride"))
    return frames.withColumn("error", frame_error(w, h, s, length.cast("long")))


def validate_frames(frames: DataFrame) -> DataFrame:
    """Adds `error`; bad frames are kept as rows, not thrown."""
    return _validated(frames, F.length("rgb"))


def validate_frames_rgb48(frames: DataFrame) -> DataFrame:
    return _validated(frames, F.size("rgb16"))


def good_frames(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("error").isNull())


def plane_pixels(plane, width: int, height: int, stride: int) -> np.ndarray:
    """(pixels, 3) in raster order, without the padding of the rows. `plane`: bytes or a buffer."""
    rows = np.frombuffer(plane, dtype=np.uint8)[: stride * height].reshape(height, stride)
    return rows[:, : 3 * width].reshape(-1, 3)


def frames_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(frame_id, pixels) of a batch of RGB8 rows, one after the other; the planes are views of the batch, not copies."""
    ids, *shape = (batch.column(c).to_pylist() for c in ("frame_id", "width", "height", "stride"))
    for i, (width, height, stride) in enumerate(zip(*shape)):
        yield ids[i], plane_pixels(batch.column("rgb")[i].as_buffer(), width, height, stride)


def frame_pixels(frames: DataFrame) -> DataFrame:
    """A row (frame_id, r, g, b) for each pixel of valid 8-bit frames.

    Pixels leave in Arrow batches of 65,536. Frames come in Arrow batches that Spark bounds by
    spark.sql.execution.arrow.maxBytesPerBatch (or by maxRecordsPerBatch rows, if that is less).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame_id, px in frames_of(batch):
                for i in range(0, len(px), 1 << 16):
                    part = px[i : i + (1 << 16)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), frame_id)), *(pa.array(part[:, k]) for k in range(3))], ["frame_id", "r", "g", "b"])

    return good_frames(validate_frames(frames)).select("frame_id", "width", "height", "stride", "rgb").mapInArrow(run, "frame_id long, r int, g int, b int")


def frame_pixels_rgb48(frames: DataFrame) -> DataFrame:
    """As frame_pixels for 16-bit frames, each channel cut to its high byte. In SQL functions only."""
    good = good_frames(validate_frames_rgb48(frames))
    spot = F.explode(F.expr("flatten(transform(sequence(0L, height - 1), y -> transform(sequence(0L, width - 1), x -> y * stride + 3 * x)))"))
    at = good.select("frame_id", "rgb16", spot.alias("at"))
    pick = lambda k: F.shiftright(F.expr(f"rgb16[cast(at + {k} as int)]"), 8)
    return at.select("frame_id", pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))


def to_rgb8(frames: DataFrame) -> DataFrame:
    """16-bit frames as 8-bit ones: every element's high byte, row padding included."""
    good = validate_frames_rgb48(frames)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes, first = [], 0
            for i in range(batch.num_rows):
                planes.append((np.asarray(batch.column(4).slice(i, 1).flatten(), dtype=np.int64) >> 8).astype(np.uint8).tobytes())
                if i + 1 == batch.num_rows or sum(map(len, planes)) > PLANES or len(planes) == 64:
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, len(planes)) for c in batch.columns[:4]), pa.array(planes, pa.binary())], ["frame_id", "width", "height", "stride", "rgb"])
                    planes, first = [], i + 1

    longs = [F.col(c).cast("long").alias(c) for c in ("frame_id", "width", "height", "stride")]
    return good_frames(good).select(*longs, "rgb16").mapInArrow(run, RGB8)
