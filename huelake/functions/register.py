"""SQL names for the scalar functions and the pixel table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources.frames import plane_pixels

# SQL bodies, inlined by Catalyst.
FUNCTIONS = {
    "srgb_to_linear(c DOUBLE)": "CASE WHEN c <= 0.04045D THEN c / 12.92D ELSE pow((c + 0.055D) / 1.055D, 2.4D) END",
    "lab_f(t DOUBLE)": "CASE WHEN t > 216.0D / 24389.0D THEN cbrt(t) ELSE t * (841.0D / 108.0D) + 4.0D / 29.0D END",
    "lab_chroma(a DOUBLE, b DOUBLE)": "sqrt(a * a + b * b)",
    "color_bin(c DOUBLE)": "cast(floor(c / 8) as double)",
    "delta_e_76_sq(l1 DOUBLE, a1 DOUBLE, b1 DOUBLE, l2 DOUBLE, a2 DOUBLE, b2 DOUBLE)": "(l1 - l2) * (l1 - l2) + (a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2)",
}


@udtf(returnType="r int, g int, b int")
class FramePixels:
    def eval(self, plane: bytes, width: int, height: int, stride: int) -> Iterator[tuple[int, int, int]]:
        for r, g, b in plane_pixels(plane, width, height, stride).tolist():
            yield r, g, b


def register(spark: SparkSession) -> None:
    """Makes the functions callable from spark.sql for this session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
    spark.udtf.register("frame_pixels", FramePixels)
