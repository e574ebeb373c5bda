import numpy as np
import pytest

from huelake.functions.colors import with_lab
from huelake.functions.algorithm import Algorithm
from huelake.operators import mmcq, nearest
from huelake.sources import frames as fr
from huelake.streaming.extract import extract_stream, write_batches

U32 = 4294967295


def plane(pixels, width, pad=0):
    a = np.array(pixels, dtype=np.uint8).reshape(-1, width, 3)
    return b"".join(row.tobytes() + b"\xff" * pad for row in a)


def dominants(pixels, count):
    a = np.array(pixels) >> 3
    hist = mmcq._dense((a[:, 0] << 10) | (a[:, 1] << 5) | a[:, 2])
    return mmcq.dominant_boxes(hist, count)


def test_single_colours():
    for value, made in (((255, 0, 0), (252, 4, 4)), ((255,) * 3, (252,) * 3), ((0,) * 3, (4,) * 3), ((8,) * 3, (12,) * 3), ((15,) * 3, (12,) * 3)):
        assert dominants([value] * 16, 5) == [(made, 16, 100.0)]


def test_shares_and_limits():
    red, blue = (255, 0, 0), (0, 0, 255)
    assert dominants([red] * 48 + [blue] * 16, 2) == [((252, 4, 4), 48, 75.0), ((4, 4, 252), 16, 25.0)]
    assert sorted(d[0] for d in dominants([red, blue] * 8, 4)) == [(4, 4, 252), (252, 4, 4)]
    assert len(dominants([red, blue] * 8, 1)) == 1 and dominants([red], 0) == []
    assert len(dominants([red] * 32 + [blue] * 32, 5)) == 2


@pytest.mark.parametrize("colours,count,populations", [
    ([(200, 30, 30), (30, 200, 30), (30, 30, 200)], 3, [22, 21, 21]),
    ([(10, 200, 10), (10, 10, 200), (200, 10, 200), (10, 200, 200), (255, 10, 10)], 5, [13, 13, 13, 13, 12]),
])
def test_cycled_colours(colours, count, populations):
    made = dominants([colours[i % len(colours)] for i in range(64)], count)
    assert [d[1] for d in made] == populations
    assert {d[0] for d in made} == {tuple((v >> 3) * 8 + 4 for v in c) for c in colours}


def test_boxes_cover_the_frame():
    rng = np.random.default_rng(3)
    for count in (2, 5, 17, 300):
        pixels = rng.integers(0, 256, (900, 3))
        made = dominants(pixels, count)
        populations = [d[1] for d in made]
        assert populations == sorted(populations, reverse=True) and len(made) <= min(count, 256)
        assert sum(populations) == 900 and sum(d[2] for d in made) == pytest.approx(100)


def test_validation(spark):
    rows = [(1, 0, 4, 12, 12), (2, 4, 0, 12, 12), (3, 4, 2, 8, 16), (4, 4, 4, 12, 30), (5, U32 // 2, 1, U32, 0), (6, 1, U32, U32, 0), (7, 1, 2, 4, 8), (8, 1, 2, 4, 7)]
    expected = ["ZeroDimension", "ZeroDimension", "StrideTooSmall", "PlaneTooShort", "WidthOverflow", "PlaneTooShort", None, "PlaneTooShort"]
    df = spark.createDataFrame([(i, w, h, s, b"\0" * n) for i, w, h, s, n in rows], fr.RGB8)
    assert [r.error for r in fr.validate_frames(df).orderBy("frame_id").collect()] == expected
    df16 = spark.createDataFrame([(i, w, h, s, [0] * n) for i, w, h, s, n in rows], fr.RGB16)
    assert [r.error for r in fr.validate_frames_rgb48(df16).orderBy("frame_id").collect()] == expected


def palette(spark):
    rows = [(i, i + 1, f"c{i}", *c) for i, c in enumerate([(255, 0, 0), (0, 0, 255), (0, 255, 0), (255, 255, 255), (0, 0, 255)])]
    return with_lab(spark.createDataFrame(rows, "palette_idx long, color_id long, name string, r int, g int, b int"))


def test_padding_and_extract(spark):
    frame = (1, 2, 2, 8, plane([(255, 0, 0)] * 4, 2, pad=2))
    df = spark.createDataFrame([frame, (2, 0, 2, 8, b"")], fr.RGB8)
    assert {tuple(r) for r in fr.frame_pixels(df).collect()} == {(1, 255, 0, 0)}
    for algorithm in (None, *Algorithm):
        assert [tuple(r) for r in mmcq.extract(df, 5, palette(spark), algorithm).collect()] == [(1, 1, 252, 4, 4, 1, 4, 100.0)]


def test_16_bits_equal_8_bits(spark):
    px = [[(200, 30, 30), (30, 200, 30), (30, 30, 200), (9, 9, 9)][i % 4] for i in range(64)]
    a = spark.createDataFrame([(1, 8, 8, 24, plane(px, 8))], fr.RGB8)
    b = spark.createDataFrame([(1, 8, 8, 24, [int(v) << 8 for p in px for v in p])], fr.RGB16)
    assert sorted(fr.frame_pixels(a).collect()) == sorted(fr.frame_pixels_rgb48(b).collect())
    p = palette(spark)
    assert sorted(mmcq.extract(a, 4, p).collect()) == sorted(mmcq.extract_rgb48(b, 4, p).collect())
    assert sorted(mmcq.extract_with(a, 4, p, "cie94").collect()) == sorted(mmcq.extract_rgb48_with(b, 4, p, "cie94").collect())
    pixels = fr.frame_pixels(a)
    assert [r[5] for r in mmcq.mmcq_pixels(pixels, 4).orderBy("rank").collect()] == [16] * 4


def test_engines_agree(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(*map(int, c),) for c in rng.integers(0, 256, (40, 3))], "r int, g int, b int")
    p = palette(spark)
    for algorithm in Algorithm:
        one, two = (sorted(nearest.nearest(df, p, algorithm, engine=e).collect()) for e in ("arrow", "join"))
        assert one == two
    exact = sorted(nearest.nearest(df, p, "ciede2000").collect())
    lut = nearest.build_lut(spark, p, df.selectExpr("shiftright(r,3)*1024 + shiftright(g,3)*32 + shiftright(b,3) AS cell"))
    assert sorted(nearest.nearest(df, p, "ciede2000", lut=lut).collect()) == exact
    assert sorted(df.join(nearest.nearest_prefiltered(df, p), ["r", "g", "b"]).collect()) == exact


def test_nulls_and_empty(spark):
    p = palette(spark)
    df = spark.createDataFrame([(None, 1, 2)], "r int, g int, b int")
    assert [tuple(r) for r in nearest.nearest(df, p).collect()] == [(None, 1, 2, None, None)]
    assert nearest.nearest(df.limit(0), p).count() == 0
    with pytest.raises(ValueError):
        nearest.nearest(df, p.limit(0), engine="join")
    assert mmcq.extract(spark.createDataFrame([], fr.RGB8), 3, p).count() == 0


def test_stream(spark, tmp_path):
    frames = spark.createDataFrame([(1, 2, 2, 6, plane([(255, 0, 0)] * 4, 2)), (2, 2, 2, 6, plane([(0, 0, 255)] * 4, 2))], fr.RGB8)
    frames.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    q = extract_stream(stream, 2, palette(spark)).writeStream.format("memory").queryName("dominants").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.frame_id, r.color_id) for r in spark.table("dominants").collect()} == {(1, 1), (2, 2)}
    got = []
    q = write_batches(stream, 2, palette(spark), lambda df, n: got.extend(df.collect()), str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert len(got) == 2
