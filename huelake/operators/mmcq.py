"""Dominant colours by modified median cut.

Frames carry their pixels, so a frame's histogram, cuts and averages are one step of one
Arrow function and nothing is shuffled. Pixel rows are first summed to a histogram, of at
most 32768 rows a frame, which then goes to one task per frame.

Ties: boxes of equal score are split latest first, and equal populations keep the order of
the last sort; a source that leaves the order of equal boxes open may differ there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.algorithm import Algorithm
from ..functions.metrics import nearest_index
from ..sources.frames import U32_MAX, frames_of, good_frames, to_rgb8, validate_frames
from ..sources.palette import PaletteArrays
from .histogram import color_histogram

SIDE = 32
MAX_BOXES = 256
MAX_ROUNDS = 1000
#: Pixels of a frame that are summed at once.
PIXELS = 1 << 18
DOMINANTS = "frame_id long, rank int, r int, g int, b int, population long, percentage double"


class Box:
    """Inclusive bounds on the three axes of a 32 x 32 x 32 histogram, with its population."""

    __slots__ = ("lo", "hi", "count")

    def __init__(self, hist: np.ndarray, lo: tuple[int, ...], hi: tuple[int, ...]) -> None:
        self.lo, self.hi = lo, hi
        self.count = min(int(self.bins(hist).sum()), U32_MAX)

    def bins(self, hist: np.ndarray) -> np.ndarray:
        return hist[tuple(slice(a, b + 1) for a, b in zip(self.lo, self.hi))]

    @property
    def widths(self) -> list[int]:
        return [b - a + 1 for a, b in zip(self.lo, self.hi)]

    @property
    def volume(self) -> int:
        return int(np.prod(self.widths))

    def average(self, hist: np.ndarray) -> tuple[int, ...]:
        if not self.count:
            return tuple(min(8 * (a + b + 1) // 2, 255) for a, b in zip(self.lo, self.hi))
        bins = self.bins(hist)
        whole = int(bins.sum())
        out = []
        for axis, (a, b) in enumerate(zip(self.lo, self.hi)):
            along = bins.sum(axis=tuple(k for k in range(3) if k != axis))
            out.append(int((along * (np.arange(a, b + 1) * 8 + 4)).sum()) // whole)
        return tuple(out)


def cut_place(along: np.ndarray) -> int | None:
    """Where to cut a box, given populations along its widest axis: the last place of the left part."""
    n = len(along)
    run = np.cumsum(along)
    over = np.flatnonzero(run > run[-1] // 2)
    if not len(over):
        return None
    i = int(over[0])
    left, right = i, n - 1 - i
    d = min(i + right // 2, n - 2) if left <= right else max(i - 1 - left // 2, 0)
    d = min(max(d, 0), n - 1)
    while d < n - 1 and run[d] == 0:
        d += 1
    while d > 0 and run[-1] - run[d] == 0 and run[d - 1] != 0:
        d -= 1
    return max(min(d, n - 2), 0)


def split(hist: np.ndarray, box: Box) -> tuple[Box, Box] | None:
    """The two parts of a box, or None if it cannot be split."""
    widths = box.widths
    if box.count <= 1 or max(widths) == 1:
        return None
    axis = widths.index(max(widths))  # red before green before blue
    d = cut_place(box.bins(hist).sum(axis=tuple(k for k in range(3) if k != axis)))
    if d is None:
        return None
    cut = box.lo[axis] + d
    swap = lambda ends, value: tuple(value if k == axis else e for k, e in enumerate(ends))
    return Box(hist, box.lo, swap(box.hi, cut)), Box(hist, swap(box.lo, cut + 1), box.hi)


def split_until(hist: np.ndarray, boxes: list[Box], target: int, score: Callable[[Box], int]) -> list[Box]:
    """Splits the box of highest score until there are `target`; boxes that cannot be split wait aside."""
    boxes, aside = list(boxes), []
    for _ in range(MAX_ROUNDS):
        if len(boxes) + len(aside) >= target or not boxes:
            break
        boxes.sort(key=score)
        box = boxes.pop()
        if not box.count:
            break
        parts = split(hist, box)
        if parts is None:
            aside.append(box)
        else:
            boxes += [p for p in parts if p.count]
    return boxes + aside[::-1]


def dominant_boxes(hist: np.ndarray, count: int) -> list[tuple[tuple[int, ...], int, float]]:
    """(colour, population, percentage) of at most `count` boxes, the most populous first."""
    filled = np.argwhere(hist)
    if count <= 0 or not len(filled):
        return []
    total = min(int(hist.sum()), U32_MAX)
    first = Box(hist, tuple(map(int, filled.min(axis=0))), tuple(map(int, filled.max(axis=0))))
    target = min(max(count, 2), MAX_BOXES)
    boxes = split_until(hist, [first], -(-3 * target // 4), lambda b: b.count)
    boxes = split_until(hist, boxes, target, lambda b: b.count * b.volume)
    ranked = sorted(boxes, key=lambda b: -b.count)
    return [(b.average(hist), b.count, min(100.0, b.count * 100.0 / total)) for b in ranked if b.count][:count]


def _rows(frame_id, hist: np.ndarray, count: int) -> list[tuple]:
    return [(frame_id, rank, *rgb, n, share) for rank, (rgb, n, share) in enumerate(dominant_boxes(hist, count), 1)]


def _dense(cells: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(cells, weights=counts, minlength=SIDE**3).astype(np.int64).reshape(SIDE, SIDE, SIDE)


def dominants_of_histogram(histogram: DataFrame, count: int) -> DataFrame:
    """DOMINANTS of each frame of a sparse histogram."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cells = (rows["r5"].to_numpy() * 1024 + rows["g5"].to_numpy() * 32 + rows["b5"].to_numpy()).astype(np.int64)
        made = _rows(rows["frame_id"].iloc[0], _dense(cells, rows["cnt"].to_numpy()), count)
        return pd.DataFrame(made, columns=[c.split()[0] for c in DOMINANTS.split(", ")])

    return histogram.groupBy("frame_id").applyInPandas(run, DOMINANTS)


def mmcq_pixels(pixels: DataFrame, count: int) -> DataFrame:
    """DOMINANTS of frames given as pixel rows."""
    return dominants_of_histogram(color_histogram(pixels), count)


def extract(frames: DataFrame, count: int, palette: DataFrame, algorithm: Algorithm | str | None = None) -> DataFrame:
    """Dominant colours of valid 8-bit frames with the palette entry of each. One pass, no shuffle.

    Spark bounds a batch of frames by spark.sql.execution.arrow.maxBytesPerBatch; a frame is read
    where it lies in its batch. The palette is bounded by its ids and travels with the function.
    """
    algorithm = Algorithm.default() if algorithm is None else algorithm if isinstance(algorithm, Algorithm) else Algorithm.parse(algorithm)
    shared = frames.sparkSession.sparkContext.broadcast(PaletteArrays(palette))
    names = ["frame_id", "rank", "r", "g", "b", "color_id", "population", "percentage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for frame_id, px in frames_of(batch):
                hist = np.zeros(SIDE**3, dtype=np.int64)
                for i in range(0, len(px), PIXELS):
                    part = px[i : i + PIXELS]
                    hist += np.bincount((part[:, 0].astype(np.int64) >> 3 << 10) | (part[:, 1].astype(np.int64) >> 3 << 5) | (part[:, 2] >> 3), minlength=SIDE**3)
                rows += _rows(frame_id, hist.reshape(SIDE, SIDE, SIDE), count)
            if rows:
                known = shared.value
                best = nearest_index(np.array([r[2:5] for r in rows]), known.lab, algorithm)
                made = [(*r[:5], int(i), *r[5:]) for r, i in zip(rows, known.ids[best])]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)

    good = good_frames(validate_frames(frames)).select("frame_id", "width", "height", "stride", "rgb")
    return good.mapInArrow(run, "frame_id long, rank int, r int, g int, b int, color_id long, population long, percentage double")


def extract_with(frames: DataFrame, count: int, palette: DataFrame, algorithm: Algorithm | str) -> DataFrame:
    return extract(frames, count, palette, algorithm)


def extract_rgb48(frames: DataFrame, count: int, palette: DataFrame) -> DataFrame:
    return extract(to_rgb8(frames), count, palette)


def extract_rgb48_with(frames: DataFrame, count: int, palette: DataFrame, algorithm: Algorithm | str) -> DataFrame:
    return extract(to_rgb8(frames), count, palette, algorithm)
