import math

import numpy as np
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from huelake.functions import colors
from huelake.functions.algorithm import Algorithm
from huelake.functions.metrics import METRICS, delta_e_2000_sq, delta_e_94_sq, nearest_index, rgb_to_lab

LAB = st.tuples(st.floats(-10, 110), st.floats(-200, 200), st.floats(-200, 200))


def lab(*rows):
    a = np.array(rows, dtype=float)
    return np.concatenate([a, np.hypot(a[:, 1], a[:, 2])[:, None]], axis=1)


def test_lab_of_white_and_black():
    white, black = rgb_to_lab(np.array([[255, 255, 255], [0, 0, 0]]))
    assert np.allclose(white, [100, 0, 0, 0], atol=0.01) and np.allclose(black, 0, atol=1e-6)


@pytest.mark.parametrize("one,two,expected", [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 3.1571, -77.2803), (50, 0, -82.7485), 2.8615), ((50, 2.5, 0), (73, 25, -18), 27.1492)])
def test_published_ciede2000_pairs(one, two, expected):
    assert math.sqrt(delta_e_2000_sq(lab(one), lab(two))[0]) == pytest.approx(expected, abs=1e-2)
    assert delta_e_2000_sq(lab(one), lab(two))[0] == pytest.approx(delta_e_2000_sq(lab(two), lab(one))[0], abs=1e-4)


def test_cie94_depends_on_the_reference():
    a, b = lab((50, 60, 40)), lab((50, 5, 5))
    assert abs(delta_e_94_sq(a, b)[0] - delta_e_94_sq(b, a)[0]) > 1


@given(LAB, LAB)
def test_metrics_are_distances(one, two):
    for metric in METRICS.values():
        assert metric(lab(one), lab(one))[0] == pytest.approx(0, abs=1e-9)
        assert metric(lab(one), lab(two))[0] >= -1e-6
    assert METRICS[Algorithm.DELTA_E_76](lab(one), lab(two))[0] == METRICS[Algorithm.DELTA_E_76](lab(two), lab(one))[0]


def test_lowest_index_wins_ties():
    palette = rgb_to_lab(np.array([[9, 9, 9], [200, 0, 0], [200, 0, 0]]))
    for algorithm in Algorithm:
        assert nearest_index(np.array([[199, 0, 0], [0, 0, 0]]), palette, algorithm).tolist() == [1, 0]


def test_columns_equal_arrays(spark):
    rgb = np.random.default_rng(1).integers(0, 256, (50, 3))
    df = spark.createDataFrame(rgb.tolist(), "r int, g int, b int")
    made = np.array(colors.with_lab(df).select("lab_l", "lab_a", "lab_b", "lab_c").collect())
    assert np.allclose(made, rgb_to_lab(rgb), atol=1e-9)
    single = np.array(df.select(*colors.rgb_to_lab(*map(F.col, "rgb"))).collect())
    assert np.allclose(single, rgb_to_lab(rgb)[:, :3], atol=1e-9)


def test_algorithm_words():
    assert Algorithm.default() is Algorithm.CIEDE2000_EXACT and str(Algorithm.CIE94) == "cie94"
    assert Algorithm.parse("CIE94") is Algorithm.CIE94 and Algorithm.from_json('"delta-e-76"') is Algorithm.DELTA_E_76
    assert Algorithm.from_json(Algorithm.CIEDE2000.to_json()) is Algorithm.CIEDE2000
    for bad in (" cie94", "cie", ""):
        with pytest.raises(ValueError, match="delta-e-76, cie94, ciede2000, ciede2000-exact"):
            Algorithm.parse(bad)
    with pytest.raises(ValueError):
        Algorithm.from_json("3")


def test_color_or_neutral(spark):
    df = spark.createDataFrame([(" neutral ",), ("color",)], "v string")
    assert [r[0] for r in df.select(colors.parse_color_or_neutral(F.col("v"))).collect()] == [True, False]
    with pytest.raises(Exception, match="not color or neutral"):
        spark.createDataFrame([("grey",)], "v string").select(colors.parse_color_or_neutral(F.col("v"))).collect()


def test_sql_names(spark):
    from huelake.functions.register import register

    register(spark)
    assert spark.sql("SELECT round(lab_chroma(3D, 4D), 3), srgb_to_linear(1D)").first()[:] == (5.0, 1.0)
    rows = spark.sql("SELECT p.* FROM (SELECT unhex('0102030405060000') AS x) t, LATERAL frame_pixels(x, 1, 2, 4) p").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 3), (5, 6, 0)]
