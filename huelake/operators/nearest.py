"""Nearest palette entry of colours, under each algorithm.

The answer depends on the colour alone, so queries are made distinct first; there are at
most 2**24 of them however many rows ask. Palettes are bounded by their 16-bit ids and
are broadcast. Two engines give the same answer: `arrow` finds the least distance in numpy
over Arrow batches (no row per pair, first index wins), `join` keeps all pairs in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.algorithm import Algorithm
from ..functions.colors import delta_e_76_sq, delta_e_94_sq, lut_cell, with_delta_e_2000, with_lab
from ..functions.metrics import delta_e_2000_sq, delta_e_76_sq as plain_distance, nearest_index, rgb_to_lab
from ..sources.palette import MAX_ROWS, PaletteArrays

RGB = ["r", "g", "b"]
#: Cells of the candidate table that one task fills: 512 colours against the palette each.
CELLS_PER_TASK = 8
CELLS = 32768
#: Largest candidate table that goes to the tasks as arrays.
LUT_ROWS = 1 << 22
#: Upper bound of CIEDE2000's weight of lightness, 1 + 0.015 * 2500 / sqrt(2520) at L of 0 and 100.
MOST_SL = 1.75


def spread(colors: DataFrame) -> DataFrame:
    """Distinct colours over all cores: they are few bytes, but much work."""
    return colors.select(*[F.col(c).cast("int").alias(c) for c in RGB]).repartition(4 * colors.sparkSession.sparkContext.defaultParallelism)


def named(colors: DataFrame, palette: DataFrame, winners: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(r, g, b, palette_idx, color_id) of distinct colours; `winners` finds entries of colours, given the palette's L, a, b and chroma."""
    shared = colors.sparkSession.sparkContext.broadcast(PaletteArrays(palette))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rgb = np.stack([np.asarray(batch.column(k)) for k in range(3)], axis=1)
            best = winners(rgb, known.lab)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known.idx[best]), pa.array(known.ids[best])], [*RGB, "palette_idx", "color_id"])

    return spread(colors).mapInArrow(run, "r int, g int, b int, palette_idx long, color_id long")


def nearest_arrow(colors: DataFrame, palette: DataFrame, algorithm: Algorithm) -> DataFrame:
    """(r, g, b, palette_idx, color_id) of distinct colours."""
    if algorithm in (Algorithm.CIEDE2000, Algorithm.CIEDE2000_EXACT):
        return named(colors, palette, nearest_by_part)
    return named(colors, palette, lambda rgb, lab: nearest_index(rgb, lab, algorithm))


def checked_palette(palette: DataFrame) -> DataFrame:
    """The palette for a broadcast, after a count of its rows."""
    if not 0 < palette.limit(MAX_ROWS + 1).count() <= MAX_ROWS:
        raise ValueError(f"a palette has 1 to {MAX_ROWS} rows")
    full = palette if "lab_c" in palette.columns else with_lab(palette)
    return F.broadcast(full.select("palette_idx", "color_id", *[F.col(f"lab_{c}").alias(f"p_{c}") for c in "labc"]))


def pair_distance(pairs: DataFrame, algorithm: Algorithm, out: str = "dist") -> DataFrame:
    """Adds the squared distance of p_ (palette, the reference) and q_ colours."""
    p, q = ([F.col(f"{x}_{c}") for c in "labc"] for x in "pq")
    if algorithm is Algorithm.DELTA_E_76:
        return pairs.withColumn(out, delta_e_76_sq(*p[:3], *q[:3]))
    if algorithm is Algorithm.CIE94:
        return pairs.withColumn(out, delta_e_94_sq(*p, *q))
    return with_delta_e_2000(pairs, "p_", "q_", out)


def nearest_join(colors: DataFrame, palette: DataFrame, algorithm: Algorithm) -> DataFrame:
    """The same in SQL: every pair of a distinct colour and an entry, and the least (distance, index)."""
    asked = with_lab(colors.select(*RGB), prefix="q_")
    pairs = pair_distance(asked.join(checked_palette(palette), F.lit(True)), algorithm)
    best = pairs.groupBy(*RGB).agg(F.min(F.struct("dist", "palette_idx", "color_id")).alias("best"))
    return best.select(*RGB, "best.palette_idx", "best.color_id")


def prefiltered_index(rgb: np.ndarray, palette_lab: np.ndarray, keep: int = 96, rows: int = 512) -> np.ndarray:
    """Of each colour's `keep` nearest entries by Delta E 76 (the lower index first where they tie), the first with the least CIEDE2000."""
    lab = rgb_to_lab(rgb)
    out = np.empty(len(rgb), dtype=np.int64)
    for i in range(0, len(rgb), rows):
        some = lab[i : i + rows]
        near = np.argsort(plain_distance(palette_lab[None, :, :], some[:, None, :]), axis=1, kind="stable")[:, :keep]
        out[i : i + rows] = near[np.arange(len(near)), delta_e_2000_sq(palette_lab[near], some[:, None, :]).argmin(axis=1)]
    return out


def nearest_prefiltered(colors: DataFrame, palette: DataFrame, keep: int = 96) -> DataFrame:
    """Approximate CIEDE2000: the `keep` nearest by Delta E 76, then the least CIEDE2000 in that order. No row per pair."""
    return named(colors, palette, lambda rgb, lab: prefiltered_index(rgb, lab, keep))


def nearest_close(rgb: np.ndarray, palette_lab: np.ndarray) -> np.ndarray:
    """Indexes of the nearest entries by CIEDE2000 of colours that lie close together.

    A distance is at least the difference of lightness over MOST_SL, so entries that differ by more
    than the worst colour's distance to one of eight near entries cannot win and are not compared.
    """
    lab = rgb_to_lab(rgb)
    near = np.argsort(plain_distance(palette_lab, lab.mean(axis=0)), kind="stable")[:8]
    most = delta_e_2000_sq(palette_lab[None, near, :], lab[:, None, :]).min(axis=1).max()
    light = palette_lab[:, 0]
    gap = np.maximum(np.maximum(lab[:, 0].min() - light, light - lab[:, 0].max()), 0.0) / MOST_SL
    able = np.flatnonzero(gap * gap <= most)  # in order, so that the lowest index wins ties as before
    return able[nearest_index(rgb, palette_lab[able], Algorithm.CIEDE2000)]


def nearest_by_part(rgb: np.ndarray, palette_lab: np.ndarray) -> np.ndarray:
    """The same for any colours, one part of 16 x 16 x 16 of the colour cube after the other."""
    part = (rgb[:, 0] >> 4 << 8) | (rgb[:, 1] >> 4 << 4) | (rgb[:, 2] >> 4)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1])))
    out = np.empty(len(rgb), dtype=np.int64)
    for some in np.split(order, cuts[1:]) if len(order) else ():
        out[some] = nearest_close(rgb[some], palette_lab)
    return out


def cell_winners(rgb: np.ndarray, palette_lab: np.ndarray) -> np.ndarray:
    """Indexes of the entries that win CIEDE2000 for some of the colours, which lie close together."""
    return np.unique(nearest_close(rgb, palette_lab))


def build_lut(spark, palette: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(cell, palette_idx): the entries that win CIEDE2000 for some colour of a 5-bit cell.

    All 32768 cells by default: 2**24 colours against the palette, built once and written.
    """
    cells = spark.range(32768).select(F.col("id").cast("int").alias("cell")) if cells is None else cells.select(F.col("cell").cast("int").alias("cell"))
    shared = spark.sparkContext.broadcast(PaletteArrays(palette))
    low = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out: list[tuple[int, int]] = []
            for cell in batch.column(0).to_pylist():
                corner = np.array([cell >> 10, cell >> 5 & 31, cell & 31]) * 8
                winners = np.unique(known.idx[cell_winners(corner + low, known.lab)])
                out += [(cell, int(w)) for w in winners]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64())], ["cell", "palette_idx"])

    each = cells.distinct()
    n = max(1, min(-(-each.count() // CELLS_PER_TASK), 4096))
    return each.repartition(n).mapInArrow(run, "cell int, palette_idx long")


def lut_statistics(lut: DataFrame) -> DataFrame:
    """Candidates in all, the mean and the most of a cell."""
    return lut.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("total"), F.avg("n").alias("average"), F.max("n").alias("most"))


def lut_index(rgb: np.ndarray, palette_lab: np.ndarray, first: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Indexes of the nearest entries by CIEDE2000 among those of each colour's cell: `entries` from first[cell] to first[cell + 1], in order."""
    cell = (rgb[:, 0] >> 3 << 10) | (rgb[:, 1] >> 3 << 5) | (rgb[:, 2] >> 3)
    many = first[cell + 1] - first[cell]
    heads = np.cumsum(many) - many
    if len(many) and not many.all():
        raise ValueError("a colour's cell is not in the candidate table")
    tried = entries[np.repeat(first[cell] - heads, many) + np.arange(int(many.sum()))]
    distance = delta_e_2000_sq(palette_lab[tried], np.repeat(rgb_to_lab(rgb), many, axis=0))
    least = np.flatnonzero(distance == np.repeat(np.minimum.reduceat(distance, heads), many)) if len(many) else heads
    return tried[least[np.searchsorted(least, heads)]]  # the first of a cell's least


def nearest_lut(colors: DataFrame, palette: DataFrame, lut: DataFrame) -> DataFrame:
    """CIEDE2000 over the candidates of a colour's cell only.

    A table of up to LUT_ROWS rows, by count, goes to the tasks as arrays; a larger one is joined by cell.
    """
    rows = lut.select(F.col("cell").cast("int").alias("cell"), F.col("palette_idx").cast("long").alias("palette_idx"))
    if rows.limit(LUT_ROWS + 1).count() <= LUT_ROWS:
        table = rows.distinct().toArrow()
        cell, idx = (table.column(k).to_numpy() for k in range(2))
        order = np.lexsort((idx, cell))
        first = np.searchsorted(cell[order], np.arange(CELLS + 1))
        known = PaletteArrays(palette)
        entries = np.searchsorted(known.idx, idx[order])
        shared = colors.sparkSession.sparkContext.broadcast((first, entries))
        return named(colors, palette, lambda rgb, lab: lut_index(rgb.astype(np.int64), lab, *shared.value))
    asked = with_lab(colors.select(*RGB), prefix="q_").withColumn("cell", lut_cell(*map(F.col, RGB)))
    pairs = pair_distance(asked.join(rows, "cell").join(checked_palette(palette), "palette_idx"), Algorithm.CIEDE2000)
    best = pairs.groupBy(*RGB).agg(F.min(F.struct("dist", "palette_idx", "color_id")).alias("best"))
    return best.select(*RGB, "best.palette_idx", "best.color_id")


def nearest(colors: DataFrame, palette: DataFrame, algorithm: Algorithm | str | None = None, *, lut: DataFrame | None = None, engine: str = "arrow") -> DataFrame:
    """`colors` (with r, g, b) and the palette_idx and color_id of each row's nearest entry."""
    algorithm = Algorithm.default() if algorithm is None else algorithm if isinstance(algorithm, Algorithm) else Algorithm.parse(algorithm)
    asked = colors.select(*RGB).where("r is not null and g is not null and b is not null").distinct()
    if lut is not None and algorithm in (Algorithm.CIEDE2000, Algorithm.CIEDE2000_EXACT):
        found = nearest_lut(asked, palette, lut)
    else:
        found = {"arrow": nearest_arrow, "join": nearest_join}[engine](asked, palette, algorithm)
    return colors.join(found, RGB, "left")
