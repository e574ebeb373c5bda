"""Pixels, palettes, ledgers and frames derived from the test tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.colors import with_lab


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Quantity bounds of the clusters of P1.
CLUSTERS = (3, 8, 15, 24, 35, 48)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1: clustered pixels of 64 frames."""
    cl = F.lit(len(CLUSTERS))
    for i in reversed(range(len(CLUSTERS))):
        cl = F.when(F.col("l_quantity") <= CLUSTERS[i], i).otherwise(cl)
    base = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 64).alias("frame_id"), (F.col("l_partkey") % 12).alias("pj"), (F.col("l_suppkey") % 12).alias("sj"), "l_linenumber", cl.alias("cl"))
    mod = lambda e: F.expr(f"cast(({e}) % 256 as int)")
    return base.select("frame_id", mod("cl*89 + frame_id*13 + pj").alias("r"), mod("cl*151 + frame_id*29 + sj").alias("g"), mod("cl*53 + frame_id*7 + l_linenumber").alias("b"))


P1 = """(SELECT frame_id, (cl*89 + frame_id*13 + pj) % 256 AS r, (cl*151 + frame_id*29 + sj) % 256 AS g, (cl*53 + frame_id*7 + l_linenumber) % 256 AS b
FROM (SELECT l_orderkey % 64 AS frame_id, l_partkey % 12 AS pj, l_suppkey % 12 AS sj, l_linenumber,
CASE WHEN l_quantity<=3 THEN 0 WHEN l_quantity<=8 THEN 1 WHEN l_quantity<=15 THEN 2 WHEN l_quantity<=24 THEN 3 WHEN l_quantity<=35 THEN 4 WHEN l_quantity<=48 THEN 5 ELSE 6 END AS cl FROM lineitem) t)"""
COLORS = f"(SELECT DISTINCT r, g, b FROM {P1} p)"


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: a palette without repeated colours."""
    part = table(spark, sf_dir, "part").where("p_partkey < 949")
    return with_lab(part.selectExpr(
        "p_partkey AS palette_idx", "p_partkey + 1 AS color_id", "p_name AS name", "cast((p_partkey*73+19) % 256 as int) AS r",
        "cast(((p_partkey div 256)*61 + p_partkey*151+7) % 256 as int) AS g", "cast(((p_partkey div 256)*97 + p_partkey*199+3) % 256 as int) AS b",
        "p_brand AS family", "p_type AS kind", "p_size % 2 = 0 AS is_neutral",
    ))


L1 = """(SELECT p_partkey AS palette_idx, p_partkey+1 AS color_id, p_name AS name, (p_partkey*73+19) % 256 AS r,
((p_partkey // 256)*61 + p_partkey*151+7) % 256 AS g, ((p_partkey // 256)*97 + p_partkey*199+3) % 256 AS b,
p_brand AS family, p_type AS kind, p_size % 2 = 0 AS is_neutral FROM part WHERE p_partkey < 949)"""


def tied_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: a palette with repeated colours."""
    part = table(spark, sf_dir, "part").where("p_partkey < 300")
    return with_lab(part.selectExpr("p_partkey AS palette_idx", "p_partkey + 1 AS color_id", "cast((p_partkey*73+19) % 256 as int) AS r", "cast((p_partkey*151+7) % 256 as int) AS g", "cast((p_partkey*199+3) % 256 as int) AS b"))


L2 = "(SELECT p_partkey AS palette_idx, p_partkey+1 AS color_id, (p_partkey*73+19) % 256 AS r, (p_partkey*151+7) % 256 AS g, (p_partkey*199+3) % 256 AS b FROM part WHERE p_partkey < 300)"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each part; some are retired."""
    return table(spark, sf_dir, "part").selectExpr("cast(p_partkey + 1 as int) AS id", "concat('colour ', p_partkey) AS xkcd_color", "p_partkey % 11 = 0 AS retired")


LEDGER = "(SELECT p_partkey + 1 AS id, 'colour ' || p_partkey AS xkcd_color, p_partkey % 11 = 0 AS retired FROM part)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in use, one for each part: 50 places on, so that the ledger's first are used no more and the last are new."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS palette_idx", "concat('colour ', p_partkey + 50) AS name")


NAMES = "(SELECT p_partkey AS palette_idx, 'colour ' || (p_partkey + 50) AS name FROM part)"

#: Geometry of a frame from a supplier's key; some are wrong on purpose.
SHAPE = {
    "width": "CASE WHEN s_suppkey % 41 = 0 THEN 2147483647 ELSE s_suppkey % 7 END",
    "height": "s_suppkey % 5",
    "stride": "CASE WHEN s_suppkey % 41 = 0 THEN 4294967295 ELSE 3 * (s_suppkey % 7) + s_suppkey % 4 - 1 END",
}
LENGTH = "CASE WHEN s_suppkey % 41 = 0 THEN 0 WHEN s_suppkey % 6 = 0 THEN 5 ELSE (3 * (s_suppkey % 7) + s_suppkey % 4) * (s_suppkey % 5) END"
SHAPES = f"(SELECT s_suppkey AS frame_id, {', '.join(f'{e} AS {k}' for k, e in SHAPE.items())}, {LENGTH} AS len FROM supplier)"
VALUE8, VALUE16 = "(i * 37 + frame_id * 11) % 256", "(i * 2659 + frame_id * 797) % 65536"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS frame_id", *[f"cast({e} as long) AS {k}" for k, e in SHAPE.items()], f"cast({LENGTH} as int) AS len")
    hexes = f"array_join(transform(slice(sequence(0L, cast(len as long)), 1, len), i -> lpad(hex({VALUE8}), 2, '0')), '')"
    return shape.selectExpr("frame_id", "width", "height", "stride", f"unhex({hexes}) AS rgb")


def frames16(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS frame_id", *[f"cast({e} as long) AS {k}" for k, e in SHAPE.items()], f"cast({LENGTH} as int) AS len")
    return shape.selectExpr("frame_id", "width", "height", "stride", f"transform(slice(sequence(0L, cast(len as long)), 1, len), i -> cast({VALUE16} as int)) AS rgb16")
