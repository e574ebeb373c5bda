"""Queries without SQL that cover whole tables where the ones with SQL take a part."""

import os

import numpy as np
import pytest

from huelake.functions.algorithm import Algorithm
from huelake.functions.metrics import nearest_index, rgb_to_lab
from huelake.operators import nearest
from huelake.plans import fixtures as fx, queries as plans

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
LOW = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)


def cell_colors(cell):
    return np.array([cell >> 10, cell >> 5 & 31, cell & 31]) * 8 + LOW


@pytest.mark.parametrize("size", [1, 3, 40, 948])
def test_cell_winners_equal_brute_force(size):
    rng = np.random.default_rng(size)
    palette = rgb_to_lab(np.concatenate([rng.integers(0, 256, (size, 3)), rng.integers(0, 256, (1, 3)).repeat(2, axis=0)]))
    for cell in [0, 32767, *rng.integers(0, 32768, 6)]:
        slow = np.unique(nearest_index(cell_colors(cell), palette, Algorithm.CIEDE2000))
        assert nearest.cell_winners(cell_colors(cell), palette).tolist() == slow.tolist()


@tables
def test_candidate_table_has_every_cell(spark):
    made = plans.QUERIES["candidate_lut_build_all_cells"](spark, SF).toPandas()
    assert sorted(made.cell.unique()) == list(range(32768)) and not made.duplicated().any()
    palette = fx.palette(spark, SF).orderBy("palette_idx").toPandas()
    lab = rgb_to_lab(palette[["r", "g", "b"]].to_numpy())
    for cell in np.random.default_rng(7).integers(0, 32768, 12):
        slow = np.unique(nearest_index(cell_colors(cell), lab, Algorithm.CIEDE2000))
        assert sorted(made[made.cell == cell].palette_idx) == sorted(palette.palette_idx.iloc[slow])
