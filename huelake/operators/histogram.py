"""Colour histograms and what is derived from them, in SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.colors import bin_center, bin_quantize
from ..sources.frames import U32_MAX


def color_histogram(pixels: DataFrame) -> DataFrame:
    """(frame_id, r5, g5, b5, cnt), counts held at the largest u32. Partial sums go before the shuffle."""
    bins = pixels.select("frame_id", bin_quantize(F.col("r")).alias("r5"), bin_quantize(F.col("g")).alias("g5"), bin_quantize(F.col("b")).alias("b5"))
    return bins.groupBy("frame_id", "r5", "g5", "b5").agg(F.least(F.count(F.lit(1)), F.lit(U32_MAX)).alias("cnt"))


def total_pixels(histogram: DataFrame) -> DataFrame:
    return histogram.groupBy("frame_id").agg(F.least(F.sum("cnt"), F.lit(U32_MAX)).alias("total"))


def initial_box(histogram: DataFrame) -> DataFrame:
    """Bounds of the populated bins of each frame."""
    ends = [f(f"{c}5").alias(f"{c}{k}") for c in "rgb" for f, k in ((F.min, 1), (F.max, 2))]
    return histogram.where("cnt > 0").groupBy("frame_id").agg(*ends)


def in_box(histogram: DataFrame, boxes: DataFrame) -> DataFrame:
    """Bins inside their frame's boxes; boxes: (frame_id, box_id, r1, r2, g1, g2, b1, b2)."""
    inside = " and ".join(f"{c}5 between {c}1 and {c}2" for c in "rgb")
    return histogram.join(boxes, "frame_id").where(inside)


def box_count(histogram: DataFrame, boxes: DataFrame) -> DataFrame:
    """Population of each box, 0 if empty."""
    some = in_box(histogram, boxes).groupBy("frame_id", "box_id").agg(F.least(F.sum("cnt"), F.lit(U32_MAX)).alias("population"))
    return boxes.select("frame_id", "box_id").join(some, ["frame_id", "box_id"], "left").withColumn("population", F.coalesce("population", F.lit(0).cast("long")))


def box_average(histogram: DataFrame, boxes: DataFrame) -> DataFrame:
    """Mean colour of each box by population; an empty box gives the middle of its bounds."""
    means = [F.floor(F.sum(F.col("cnt") * bin_center(F.col(f"{c}5"))).cast("double") / F.sum("cnt").cast("double")).alias(f"__{c}") for c in "rgb"]
    some = in_box(histogram, boxes).groupBy("frame_id", "box_id").agg(*means)
    middle = lambda c: F.least(F.floor((F.col(f"{c}1") + F.col(f"{c}2") + 1) * 8 / F.lit(2)), F.lit(255).cast("long"))
    joined = boxes.join(some, ["frame_id", "box_id"], "left")
    return joined.select("frame_id", "box_id", *[F.coalesce(F.col(f"__{c}"), middle(c)).cast("int").alias(c) for c in "rgb"])


def with_percentage(dominants: DataFrame, totals: DataFrame) -> DataFrame:
    return dominants.join(totals, "frame_id").withColumn("percentage", F.col("population") * 100.0 / F.col("total")).drop("total")


def axis_cumsum(histogram: DataFrame, axis: str, lo: int, hi: int) -> DataFrame:
    """(frame_id, pos, cumsum, lookahead) of the populations along an axis over lo..hi, holes included."""
    frames = histogram.select("frame_id").distinct()
    spine = frames.withColumn("pos", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    sums = histogram.groupBy("frame_id", F.col(axis).alias("pos")).agg(F.sum("cnt").alias("n"))
    order = Window.partitionBy("frame_id").orderBy("pos")
    whole = Window.partitionBy("frame_id")
    filled = spine.join(sums, ["frame_id", "pos"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    running = filled.withColumn("cumsum", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return running.withColumn("lookahead", F.sum("n").over(whole) - F.col("cumsum")).drop("n")


def median_slice(cumsums: DataFrame) -> DataFrame:
    """First position whose cumulated population exceeds half of the whole."""
    half = F.floor((F.col("cumsum") + F.col("lookahead")) / 2)
    return cumsums.where(F.col("cumsum") > half).groupBy("frame_id").agg(F.min("pos").alias("median"))


def top_bins(histogram: DataFrame, k: int) -> DataFrame:
    """The k largest bins of each frame; ties by bin."""
    order = Window.partitionBy("frame_id").orderBy(F.desc("cnt"), "r5", "g5", "b5")
    return histogram.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
