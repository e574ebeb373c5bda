"""The palette table: from the 18-column hierarchy CSV, or from any table of colours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.colors import parse_color_or_neutral, with_lab

#: Ids are unsigned 16-bit numbers and 0 is none, so a palette cannot have more rows; this bounds what is broadcast.
MAX_ROWS = 65535
# The columns of the hierarchy CSV, in order.
HIERARCHY = (
    "xkcd_color string, xkcd_hex string, xkcd_r int, xkcd_g int, xkcd_b int, design_color string, design_hex string, design_r int, design_g int, design_b int, "
    "common_color string, common_hex string, common_r int, common_g int, common_b int, color_family string, color_type string, color_or_neutral string"
)


def bounded(table: DataFrame, what: str = "a palette") -> DataFrame:
    """`table`, once a count has shown that it is small enough to broadcast or collect."""
    if table.limit(MAX_ROWS + 1).count() > MAX_ROWS:
        raise ValueError(f"{what} has at most {MAX_ROWS} rows")
    return table


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """The CSV with palette_idx, its 0-based order. A palette is bounded, so one task numbers it."""
    rows = spark.read.schema(HIERARCHY).csv(path, header=True, mode="FAILFAST", multiLine=True, escape='"')
    count = rows.limit(MAX_ROWS + 1).count()
    if not 0 < count <= MAX_ROWS:
        raise ValueError(f"a palette has 1 to {MAX_ROWS} rows")
    place = rows.coalesce(1).withColumn("__at", F.monotonically_increasing_id())
    return place.withColumn("palette_idx", (F.row_number().over(Window.orderBy("__at")) - 1).cast("long")).drop("__at")


def build_palette(hierarchy: DataFrame, ledger: DataFrame) -> DataFrame:
    """The full palette schema. `ledger`: (id, xkcd_color, retired); every name needs its id. Only the names' own rows of it are looked at."""
    for column in ("color_family", "color_type"):
        if hierarchy.where(F.trim(F.coalesce(F.col(column), F.lit(""))) == "").limit(1).count():
            raise ValueError(f"empty {column}")
    used = ledger.join(F.broadcast(bounded(hierarchy).select("xkcd_color").distinct()), "xkcd_color", "left_semi")
    joined = hierarchy.join(used.select(F.col("id").cast("long").alias("color_id"), "xkcd_color"), "xkcd_color", "left")
    if joined.where("color_id is null").limit(1).count():
        raise ValueError("a colour has no id in the ledger")
    named = joined.select(
        "palette_idx", "color_id", F.col("xkcd_color").alias("name"), F.col("xkcd_hex").alias("hex"), *[F.col(f"xkcd_{c}").alias(c) for c in "rgb"],
        F.col("design_color").alias("design_name"), "design_hex", "design_r", "design_g", "design_b", F.col("common_color").alias("common_name"), "common_hex", "common_r", "common_g", "common_b",
        F.trim("color_family").alias("family"), F.trim("color_type").alias("kind"), parse_color_or_neutral(F.col("color_or_neutral")).alias("is_neutral"),
    )
    return with_lab(named)


def palette_scan(palette: DataFrame) -> DataFrame:
    """All entries; palette_idx is their order."""
    return palette


def filter_family(palette: DataFrame, family: str) -> DataFrame:
    return palette.where(F.col("family") == family)


def distinct_words(palette: DataFrame, column: str) -> DataFrame:
    """The sorted distinct values of `family` or `kind`."""
    return palette.select(F.trim(column).alias(column)).distinct().orderBy(column)


def color_from_id(queries: DataFrame, palette: DataFrame, column: str = "color_id") -> DataFrame:
    """Left lookup: unknown ids and 0 find nothing."""
    return queries.join(F.broadcast(bounded(palette)), column, "left")


class PaletteArrays:
    """A palette's colours on the driver, at most MAX_ROWS of them, for Arrow functions."""

    def __init__(self, palette: DataFrame) -> None:
        columns = ["palette_idx", "color_id", "lab_l", "lab_a", "lab_b", "lab_c"]
        if "lab_c" not in palette.columns:
            palette = with_lab(palette)
        rows = palette.select(*columns).orderBy("palette_idx").limit(MAX_ROWS + 1).collect()
        if not 0 < len(rows) <= MAX_ROWS:
            raise ValueError(f"a palette has 1 to {MAX_ROWS} rows")
        self.idx = np.array([r[0] for r in rows], dtype=np.int64)
        self.ids = np.array([r[1] for r in rows], dtype=np.int64)
        self.lab = np.array([r[2:] for r in rows], dtype=np.float64)
