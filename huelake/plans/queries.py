"""The registered queries of the colour operators, and their DuckDB equivalents."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import colors
from ..functions.algorithm import Algorithm
from ..operators import histogram as hist, mmcq, nearest as near
from ..sources import frames as fr, ledger as led, palette as pal
from . import fixtures as fx, sqltext as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """The columns named, in order, as long, double, string or boolean."""
    return df.select(*[(F.round(F.col(k), 6) if kind == "double" else F.col(k)).cast(kind).alias(k) for k, kind in kinds.items()])


def wanted(sql: str, **kinds: str) -> str:
    names = {"long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    return "SELECT " + ", ".join(f"cast({f'round({k}, 6)' if kind == 'double' else k} AS {names[kind]}) AS {k}" for k, kind in kinds.items()) + f" FROM {sql} w"


HIST = f"(SELECT frame_id, r // 8 AS r5, g // 8 AS g5, b // 8 AS b5, least(count(*), 4294967295) AS cnt FROM {fx.P1} p GROUP BY ALL)"
TOP = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY cnt DESC, r5, g5, b5) AS rank FROM {HIST} h) t WHERE rank <= 5)"
PAL = q.with_lab(fx.L1)
RGBN = dict(r="long", g="long", b="long")
FOUND = dict(**RGBN, palette_idx="long", color_id="long")


def p_pal(l: str) -> str:
    return f"(SELECT palette_idx, color_id, lab_l AS p_l, lab_a AS p_a, lab_b AS p_b, lab_c AS p_c FROM {q.with_lab(l)} t)"


def pairs(asked: str, l: str = fx.L1) -> str:
    return f"(SELECT * FROM {q.with_lab(asked, 'q_')} a CROSS JOIN {p_pal(l)} p)"


def winner(rel: str, key: str = "dist, palette_idx", by: str = "r, g, b") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {key}) AS place_ FROM {rel} t) t WHERE place_ = 1)"


# ---- sources ----


@query(wanted(f"(SELECT frame_id, CASE WHEN width = 0 OR height = 0 THEN 'ZeroDimension' WHEN width * 3 > 4294967295 THEN 'WidthOverflow' WHEN stride < width * 3 THEN 'StrideTooSmall' WHEN len < stride * height THEN 'PlaneTooShort' END AS error FROM {fx.SHAPES} s)", frame_id="long", error="string"))
def frame_validate(spark, sf_dir):
    return typed(fr.validate_frames(fx.frames(spark, sf_dir)), frame_id="long", error="string")


ORACLES["frame_validate_rgb48"] = ORACLES["frame_validate"]


@query(ORACLES["frame_validate"])
def frame_validate_rgb48(spark, sf_dir):
    return typed(fr.validate_frames_rgb48(fx.frames16(spark, sf_dir)), frame_id="long", error="string")


def _pixels_sql(value: str) -> str:
    good = f"(SELECT * FROM {fx.SHAPES} s WHERE NOT (width = 0 OR height = 0 OR width * 3 > 4294967295 OR stride < width * 3 OR len < stride * height))"
    spots = f"(SELECT frame_id, stride, x, unnest(range(0, cast(height AS BIGINT))) AS y FROM (SELECT *, unnest(range(0, cast(width AS BIGINT))) AS x FROM {good} g) t)"
    pick = lambda k: value.replace("(i ", f"((y * stride + 3 * x + {k}) ")
    return f"(SELECT frame_id, {pick(0)} AS r, {pick(1)} AS g, {pick(2)} AS b FROM {spots} s)"


@query(wanted(_pixels_sql(fx.VALUE8), frame_id="long", **RGBN))
def frame_pixels(spark, sf_dir):
    return typed(fr.frame_pixels(fx.frames(spark, sf_dir)), frame_id="long", **RGBN)


@query(wanted(f"(SELECT frame_id, r // 256 AS r, g // 256 AS g, b // 256 AS b FROM {_pixels_sql(fx.VALUE16)} t)", frame_id="long", **RGBN))
def frame_pixels_rgb48(spark, sf_dir):
    return typed(fr.frame_pixels_rgb48(fx.frames16(spark, sf_dir)), frame_id="long", **RGBN)


PALETTE = dict(palette_idx="long", color_id="long", name="string", **RGBN, family="string", kind="string", is_neutral="boolean", lab_l="double", lab_a="double", lab_b="double", lab_c="double")


@query(wanted(PAL, **PALETTE))
def palette_scan(spark, sf_dir):
    return typed(pal.palette_scan(fx.palette(spark, sf_dir)), **PALETTE)


@query("SELECT cast(count(*) AS BIGINT) AS n FROM part WHERE p_partkey < 949 AND p_brand = 'Brand#11'")
def palette_filter_family(spark, sf_dir):
    return pal.filter_family(fx.palette(spark, sf_dir), "Brand#11").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT trim(p_brand) AS family FROM part WHERE p_partkey < 949")
def family_distinct(spark, sf_dir):
    return pal.distinct_words(fx.palette(spark, sf_dir), "family")


@query("SELECT DISTINCT trim(p_type) AS kind FROM part WHERE p_partkey < 949")
def kind_distinct(spark, sf_dir):
    return pal.distinct_words(fx.palette(spark, sf_dir), "kind")


@query(wanted(f"(SELECT s.color_id, p.palette_idx, p.r, p.g, p.b FROM (SELECT DISTINCT l_partkey % 1200 AS color_id FROM lineitem) s LEFT JOIN {fx.L1} p ON s.color_id = p.color_id)", color_id="long", palette_idx="long", **RGBN))
def color_from_id(spark, sf_dir):
    asked = fx.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 1200).alias("color_id")).distinct()
    return typed(pal.color_from_id(asked, fx.palette(spark, sf_dir)), color_id="long", palette_idx="long", **RGBN)


@query(wanted("(SELECT p_partkey AS palette_idx, p_size % 2 = 0 AS is_neutral FROM part)", palette_idx="long", is_neutral="boolean"))
def parse_color_or_neutral(spark, sf_dir):
    word = F.when(F.col("p_size") % 2 == 0, " neutral ").otherwise("color")
    return typed(fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("palette_idx"), colors.parse_color_or_neutral(word).alias("is_neutral")), palette_idx="long", is_neutral="boolean")


# ---- bins and scalars, over the distinct colours of P1 ----


def distinct_colors(spark, sf_dir) -> DataFrame:
    return fx.pixels(spark, sf_dir).select("r", "g", "b").distinct()


BINS = dict(**RGBN, r5="long", g5="long", b5="long")


@query(wanted(q.add(fx.COLORS, r5="r // 8", g5="g // 8", b5="b // 8"), **BINS))
def bin_quantize(spark, sf_dir):
    return typed(distinct_colors(spark, sf_dir).withColumns({f"{c}5": colors.bin_quantize(F.col(c)) for c in "rgb"}), **BINS)


@query(wanted(q.add(fx.COLORS, bin="(r // 8) * 1024 + (g // 8) * 32 + b // 8"), **RGBN, bin="long"))
def bin_index(spark, sf_dir):
    return typed(distinct_colors(spark, sf_dir).withColumn("bin", colors.bin_index(*[colors.bin_quantize(F.col(c)) for c in "rgb"])), **RGBN, bin="long")


@query(wanted(q.add(fx.COLORS, rc="(r // 8) * 8 + 4", gc="(g // 8) * 8 + 4", bc="(b // 8) * 8 + 4"), **RGBN, rc="long", gc="long", bc="long"))
def bin_center(spark, sf_dir):
    return typed(distinct_colors(spark, sf_dir).withColumns({f"{c}c": colors.bin_center(colors.bin_quantize(F.col(c))) for c in "rgb"}), **RGBN, rc="long", gc="long", bc="long")


@query(wanted(q.add(fx.COLORS, cell="(r // 8) * 1024 + (g // 8) * 32 + b // 8"), **RGBN, cell="long"))
def lut_cell(spark, sf_dir):
    return typed(distinct_colors(spark, sf_dir).withColumn("cell", colors.lut_cell(*map(F.col, "rgb"))), **RGBN, cell="long")


@query(wanted(q.add("(SELECT range AS c FROM range(0, 256))", v=q.linear("c")), c="long", v="double"))
def srgb_to_linear(spark, sf_dir):
    return typed(spark.range(256).select(F.col("id").alias("c"), colors.srgb_to_linear(F.col("id").cast("double") / 255.0).alias("v")), c="long", v="double")


@query(wanted(q.add("(SELECT range AS i FROM range(0, 1000))", v=q.lab_f("(cast(i AS DOUBLE) / cast(997.0 AS DOUBLE))")), i="long", v="double"))
def lab_f(spark, sf_dir):
    return typed(spark.range(1000).select(F.col("id").alias("i"), colors.lab_f(F.col("id").cast("double") / 997.0).alias("v")), i="long", v="double")


LAB = dict(**RGBN, lab_l="double", lab_a="double", lab_b="double")


@query(wanted(q.with_lab(fx.COLORS), **LAB))
def rgb_to_lab(spark, sf_dir):
    return typed(colors.with_lab(distinct_colors(spark, sf_dir)), **LAB)


@query(wanted(q.with_lab(fx.COLORS), **RGBN, lab_c="double"))
def lab_chroma(spark, sf_dir):
    return typed(colors.with_lab(distinct_colors(spark, sf_dir)), **RGBN, lab_c="double")


#: Each palette entry with the entry after it, to try the metrics on.
NEXT_SQL = f"(SELECT p.*, a.r, a.g, a.b, a.lab_l AS q_l, a.lab_a AS q_a, a.lab_b AS q_b, a.lab_c AS q_c FROM {p_pal(fx.L1)} p JOIN {PAL} a ON a.palette_idx = p.palette_idx + 1)"


def next_pairs(spark, sf_dir) -> DataFrame:
    full = fx.palette(spark, sf_dir)
    one = full.select("palette_idx", *[F.col(f"lab_{c}").alias(f"p_{c}") for c in "labc"])
    two = full.select((F.col("palette_idx") - 1).alias("palette_idx"), *[F.col(f"lab_{c}").alias(f"q_{c}") for c in "labc"])
    return one.join(two, "palette_idx")


def _metric(spark, sf_dir, algorithm: Algorithm) -> DataFrame:
    return typed(near.pair_distance(next_pairs(spark, sf_dir), algorithm), palette_idx="long", dist="double")


@query(wanted(q.add(NEXT_SQL, dist=q.de76()), palette_idx="long", dist="double"))
def delta_e_76_sq(spark, sf_dir):
    return _metric(spark, sf_dir, Algorithm.DELTA_E_76)


@query(wanted(q.add(NEXT_SQL, dist=q.de94()), palette_idx="long", dist="double"))
def delta_e_94_sq(spark, sf_dir):
    return _metric(spark, sf_dir, Algorithm.CIE94)


@query(wanted(q.with_de00(NEXT_SQL), palette_idx="long", dist="double"))
def delta_e_2000_sq(spark, sf_dir):
    return _metric(spark, sf_dir, Algorithm.CIEDE2000)


@query(wanted(q.add(PAL, hue=q.hue("lab_b", "lab_a")), palette_idx="long", hue="double"))
def hue_deg(spark, sf_dir):
    return typed(fx.palette(spark, sf_dir).withColumn("hue", colors.hue_deg(F.col("lab_b"), F.col("lab_a"))), palette_idx="long", hue="double")


@query(wanted(q.add("(SELECT range AS i FROM range(0, 500))", v=q.pow7("cast(i AS DOUBLE) / cast(100.0 AS DOUBLE)")), i="long", v="double"))
def pow7(spark, sf_dir):
    return typed(spark.range(500).select(F.col("id").alias("i"), colors.pow7(F.col("id").cast("double") / 100.0).alias("v")), i="long", v="double")


# ---- nearest ----


#: Colours to name: all that the pixels have.
ASKED = fx.COLORS


@query(wanted(winner(q.add(pairs(ASKED), dist=q.de76())), **FOUND))
def nearest_delta_e_76(spark, sf_dir):
    return typed(near.nearest(distinct_colors(spark, sf_dir), fx.palette(spark, sf_dir), "delta-e-76"), **FOUND)


@query(wanted(winner(q.add(pairs(ASKED, fx.L2), dist=q.de76())), **FOUND))
def nearest_delta_e_76_ties(spark, sf_dir):
    return typed(near.nearest(distinct_colors(spark, sf_dir), fx.tied_palette(spark, sf_dir), "delta-e-76", engine="join"), **FOUND)


@query(wanted(winner(q.add(pairs(ASKED), dist=q.de94())), **FOUND))
def nearest_cie94(spark, sf_dir):
    return typed(near.nearest(distinct_colors(spark, sf_dir), fx.palette(spark, sf_dir), "cie94"), **FOUND)


@query(wanted(winner(q.with_de00(pairs(ASKED))), **FOUND))
def nearest_ciede2000(spark, sf_dir):
    return typed(near.nearest(distinct_colors(spark, sf_dir), fx.palette(spark, sf_dir), "ciede2000"), **FOUND)


@query(ORACLES["nearest_ciede2000"])
def nearest_ciede2000_lut(spark, sf_dir):
    asked = distinct_colors(spark, sf_dir)
    lut = near.build_lut(spark, fx.palette(spark, sf_dir), asked.select(colors.lut_cell(*map(F.col, "rgb")).alias("cell")))
    return typed(near.nearest(asked, fx.palette(spark, sf_dir), "ciede2000-exact", lut=lut), **FOUND)


@query(ORACLES["nearest_ciede2000"])
def nearest_ciede2000_exact(spark, sf_dir):
    return typed(near.nearest(distinct_colors(spark, sf_dir), fx.palette(spark, sf_dir), Algorithm.CIEDE2000_EXACT), **FOUND)


_WORDS = {"delta-e-76": "nearest_delta_e_76", "cie94": "nearest_cie94", "ciede2000": "nearest_ciede2000", "ciede2000-exact": "nearest_ciede2000"}


@query(" UNION ALL ".join(f"SELECT *, '{word}' AS algorithm FROM ({ORACLES[name]}) t" for word, name in _WORDS.items()))
def nearest(spark, sf_dir):
    """The dispatch by word: each algorithm's answers, one below the other."""
    asked, palette = distinct_colors(spark, sf_dir), fx.palette(spark, sf_dir)
    first, *rest = (typed(near.nearest(asked, palette, word), **FOUND).withColumn("algorithm", F.lit(word)) for word in _WORDS)
    for df in rest:
        first = first.union(df)
    return first


_SPELLINGS = ("delta-e-76", "DELTA-E-76", "Cie94", "ciede2000", "CIEDE2000-Exact", " cie94", "cie-94", "")


@query("""SELECT * FROM (VALUES ('delta-e-76', 'delta-e-76'), ('DELTA-E-76', 'delta-e-76'), ('Cie94', 'cie94'), ('ciede2000', 'ciede2000'),
('CIEDE2000-Exact', 'ciede2000-exact'), (' cie94', NULL), ('cie-94', NULL), ('', NULL)) t(given, word)""")
def parse_algorithm(spark, sf_dir):
    """The word of each spelling; null where it is refused."""

    def word(given: str) -> str | None:
        try:
            return str(Algorithm.parse(given))
        except ValueError:
            return None

    return spark.createDataFrame([(x, word(x)) for x in _SPELLINGS], "given string, word string")


_NEAR96 = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, g, b ORDER BY d76, palette_idx) AS place FROM {q.add(pairs(ASKED), d76=q.de76())} t) t WHERE place <= 96)"


@query(wanted(winner(q.with_de00(_NEAR96), "dist, place"), **FOUND))
def nearest_ciede2000_prefiltered(spark, sf_dir):
    return typed(near.nearest_prefiltered(distinct_colors(spark, sf_dir), fx.palette(spark, sf_dir)), **FOUND)


def pixel_lut(spark, sf_dir) -> DataFrame:
    """The candidates of all cells that the pixels fall into. Without SQL: it would compare some 2 million colours with every entry."""
    return near.build_lut(spark, fx.palette(spark, sf_dir), distinct_colors(spark, sf_dir).select(colors.lut_cell(*map(F.col, "rgb")).alias("cell")))


@query()
def candidate_lut_build(spark, sf_dir):
    return typed(pixel_lut(spark, sf_dir), cell="long", palette_idx="long")


@query()
def lut_statistics(spark, sf_dir):
    return typed(near.lut_statistics(pixel_lut(spark, sf_dir)), total="long", average="double", most="long")


@query()
def candidate_lut_build_all_cells(spark, sf_dir):
    return typed(near.build_lut(spark, fx.palette(spark, sf_dir)), cell="long", palette_idx="long")


# ---- histograms and boxes ----

HISTO = dict(frame_id="long", r5="long", g5="long", b5="long", cnt="long")


def _hist(spark, sf_dir) -> DataFrame:
    return hist.color_histogram(fx.pixels(spark, sf_dir))


@query(wanted(HIST, **HISTO))
def color_histogram(spark, sf_dir):
    return typed(_hist(spark, sf_dir), **HISTO)


@query(wanted(f"(SELECT frame_id, sum(cnt) AS total FROM {HIST} h GROUP BY frame_id)", frame_id="long", total="long"))
def total_pixels(spark, sf_dir):
    return typed(hist.total_pixels(_hist(spark, sf_dir)), frame_id="long", total="long")


BOX = dict(frame_id="long", r1="long", r2="long", g1="long", g2="long", b1="long", b2="long")
_ENDS = ", ".join(f"{f}({c}5) AS {c}{k}" for c in "rgb" for f, k in (("min", 1), ("max", 2)))
BOX_SQL = f"(SELECT frame_id, {_ENDS} FROM {HIST} h GROUP BY frame_id)"


@query(wanted(BOX_SQL, **BOX))
def initial_box(spark, sf_dir):
    return typed(hist.initial_box(_hist(spark, sf_dir)), **BOX)


#: Two boxes a frame: the lower half of its red axis, and bounds that hold nothing.
BOXES_SQL = f"(SELECT frame_id, 0 AS box_id, r1, (r1 + r2) // 2 AS r2, g1, g2, b1, b2 FROM {BOX_SQL} x UNION ALL SELECT frame_id, 1, 40, 43, 1, 2, 3, 5 FROM {BOX_SQL} x)"
_IN = " AND ".join(f"h.{c}5 BETWEEN x.{c}1 AND x.{c}2" for c in "rgb")


def _boxes(spark, sf_dir) -> DataFrame:
    first = hist.initial_box(_hist(spark, sf_dir))
    low = first.selectExpr("frame_id", "0 AS box_id", "r1", "cast((r1 + r2) div 2 as int) AS r2", "g1", "g2", "b1", "b2")
    return low.union(first.selectExpr("frame_id", "1", "40", "43", "1", "2", "3", "5"))


@query(wanted(f"(SELECT x.frame_id, x.box_id, coalesce(sum(h.cnt), 0) AS population FROM {BOXES_SQL} x LEFT JOIN {HIST} h ON h.frame_id = x.frame_id AND {_IN} GROUP BY x.frame_id, x.box_id)", frame_id="long", box_id="long", population="long"))
def box_count(spark, sf_dir):
    return typed(hist.box_count(_hist(spark, sf_dir), _boxes(spark, sf_dir)), frame_id="long", box_id="long", population="long")


_AVG = ", ".join(f"coalesce(trunc(cast(sum(h.cnt * (h.{c}5 * 8 + 4)) AS DOUBLE) / cast(sum(h.cnt) AS DOUBLE)), least((8 * (min(x.{c}1) + min(x.{c}2) + 1)) // 2, 255)) AS {c}" for c in "rgb")


@query(wanted(f"(SELECT x.frame_id, x.box_id, {_AVG} FROM {BOXES_SQL} x LEFT JOIN {HIST} h ON h.frame_id = x.frame_id AND {_IN} GROUP BY x.frame_id, x.box_id)", frame_id="long", box_id="long", **RGBN))
def box_average(spark, sf_dir):
    return typed(hist.box_average(_hist(spark, sf_dir), _boxes(spark, sf_dir)), frame_id="long", box_id="long", **RGBN)


@query(wanted(f"(SELECT t.frame_id, t.rank, t.cnt AS population, cast(100.0 AS DOUBLE) * t.cnt / s.total AS percentage FROM {TOP} t JOIN (SELECT frame_id, sum(cnt) AS total FROM {HIST} h GROUP BY frame_id) s ON s.frame_id = t.frame_id)", frame_id="long", rank="long", population="long", percentage="double"))
def dominant_percentage(spark, sf_dir):
    bins = _hist(spark, sf_dir)
    return typed(hist.with_percentage(hist.top_bins(bins, 5).withColumnRenamed("cnt", "population"), hist.total_pixels(bins)), frame_id="long", rank="long", population="long", percentage="double")


_SPINE = f"(SELECT f.frame_id, s.pos, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT frame_id FROM {HIST} h) f CROSS JOIN (SELECT range AS pos FROM range(0, 32)) s LEFT JOIN (SELECT frame_id, r5, sum(cnt) AS n FROM {HIST} h GROUP BY frame_id, r5) n ON n.frame_id = f.frame_id AND n.r5 = s.pos)"
_CUM = f"(SELECT frame_id, pos, cumsum, total - cumsum AS lookahead FROM (SELECT frame_id, pos, sum(n) OVER (PARTITION BY frame_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cumsum, sum(n) OVER (PARTITION BY frame_id) AS total FROM {_SPINE} t) t)"


@query(wanted(_CUM, frame_id="long", pos="long", cumsum="long"))
def axis_cumsum(spark, sf_dir):
    return typed(hist.axis_cumsum(_hist(spark, sf_dir), "r5", 0, 31), frame_id="long", pos="long", cumsum="long")


@query(wanted(_CUM, frame_id="long", pos="long", lookahead="long"))
def axis_lookahead(spark, sf_dir):
    return typed(hist.axis_cumsum(_hist(spark, sf_dir), "r5", 0, 31), frame_id="long", pos="long", lookahead="long")


@query(wanted(f"(SELECT frame_id, min(pos) AS median FROM {_CUM} t WHERE cumsum > (cumsum + lookahead) // 2 GROUP BY frame_id)", frame_id="long", median="long"))
def median_slice(spark, sf_dir):
    return typed(hist.median_slice(hist.axis_cumsum(_hist(spark, sf_dir), "r5", 0, 31)), frame_id="long", median="long")


NAMED = dict(frame_id="long", rank="long", **RGBN, cnt="long", palette_idx="long", color_id="long")
_CENTRES = f"(SELECT frame_id, rank, cnt, r5 * 8 + 4 AS r, g5 * 8 + 4 AS g, b5 * 8 + 4 AS b FROM {TOP} t)"


@query(wanted(winner(q.add(pairs(_CENTRES), dist=q.de76()), by="frame_id, rank"), **NAMED))
def top_bins_named(spark, sf_dir):
    """The flagship: histogram, largest bins, and the name of each bin's centre."""
    top = hist.top_bins(_hist(spark, sf_dir), 5).withColumns({c: colors.bin_center(F.col(f"{c}5")) for c in "rgb"})
    return typed(near.nearest(top, fx.palette(spark, sf_dir), Algorithm.DELTA_E_76), **NAMED)


# ---- median cut ----

DOMINANT = dict(frame_id="long", rank="long", **RGBN, population="long", percentage="double")


@query()
def mmcq_extract(spark, sf_dir):
    return typed(mmcq.mmcq_pixels(fx.pixels(spark, sf_dir), 5), **DOMINANT)


@query()
def dominants_top_k(spark, sf_dir):
    return typed(mmcq.mmcq_pixels(fx.pixels(spark, sf_dir), 3), **DOMINANT)


def _cut_sql() -> str:
    """One median cut of every frame's initial box, for two dominants."""
    axis = "CASE WHEN r2 - r1 >= g2 - g1 AND r2 - r1 >= b2 - b1 THEN 0 WHEN g2 - g1 >= b2 - b1 THEN 1 ELSE 2 END"
    boxed = q.add(q.add(BOX_SQL, axis=axis), lo="CASE axis WHEN 0 THEN r1 WHEN 1 THEN g1 ELSE b1 END", hi="CASE axis WHEN 0 THEN r2 WHEN 1 THEN g2 ELSE b2 END")
    bins = f"(SELECT h.*, x.lo, x.hi, CASE x.axis WHEN 0 THEN h.r5 WHEN 1 THEN h.g5 ELSE h.b5 END AS v FROM {HIST} h JOIN {boxed} x ON x.frame_id = h.frame_id)"
    line = f"(SELECT frame_id, v, any_value(lo) AS lo, any_value(hi) AS hi, sum(cnt) AS n FROM {bins} t GROUP BY frame_id, v)"
    run = f"(SELECT *, sum(n) OVER (PARTITION BY frame_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS ps, sum(n) OVER (PARTITION BY frame_id) AS total FROM {line} t)"
    mid = f"(SELECT frame_id, min(v) AS i, any_value(lo) AS lo, any_value(hi) AS hi FROM {run} t WHERE ps > total // 2 GROUP BY frame_id)"
    # both ends of the initial box are populated, so no empty part is met on the way
    place = f"(SELECT frame_id, greatest(least(CASE WHEN i - lo <= hi - i THEN least(i + (hi - i) // 2, hi - 1) ELSE greatest(i - 1 - (i - lo) // 2, lo) END, hi - 1), lo) AS d FROM {mid} t)"
    part = f"(SELECT b.*, CASE WHEN b.v <= p.d THEN 0 ELSE 1 END AS side FROM {bins} b JOIN {place} p ON p.frame_id = b.frame_id)"
    means = ", ".join(f"trunc(cast(sum(cnt * ({c}5 * 8 + 4)) AS DOUBLE) / cast(sum(cnt) AS DOUBLE)) AS {c}" for c in "rgb")
    return f"(SELECT frame_id, sum(cnt) AS population, {means} FROM {part} t GROUP BY frame_id, side)"


CUT = dict(frame_id="long", **RGBN, population="long")


@query(wanted(_cut_sql(), **CUT))
def median_cut(spark, sf_dir):
    return typed(mmcq.mmcq_pixels(fx.pixels(spark, sf_dir), 2), **CUT)


EXTRACT = dict(frame_id="long", rank="long", **RGBN, color_id="long", population="long", percentage="double")


@query()
def extract(spark, sf_dir):
    return typed(mmcq.extract(fx.frames(spark, sf_dir), 4, fx.palette(spark, sf_dir)), **EXTRACT)


@query()
def extract_with(spark, sf_dir):
    return typed(mmcq.extract_with(fx.frames(spark, sf_dir), 4, fx.palette(spark, sf_dir), "cie94"), **EXTRACT)


@query()
def extract_rgb48(spark, sf_dir):
    return typed(mmcq.extract_rgb48(fx.frames16(spark, sf_dir), 4, fx.palette(spark, sf_dir)), **EXTRACT)


@query()
def extract_rgb48_with(spark, sf_dir):
    return typed(mmcq.extract_rgb48_with(fx.frames16(spark, sf_dir), 4, fx.palette(spark, sf_dir), "delta-e-76"), **EXTRACT)


# ---- ledger ----

LEDGER = dict(id="long", xkcd_color="string", retired="boolean")
#: The ledger of these queries has a row for each part, and as many ids as its column holds.
WIDE = (1 << 31) - 1


@query(wanted(f"(SELECT n.palette_idx, n.name, coalesce(l.id, m.top + row_number() OVER (PARTITION BY l.id IS NULL ORDER BY n.palette_idx)) AS id FROM {fx.NAMES} n LEFT JOIN {fx.LEDGER} l ON l.xkcd_color = n.name CROSS JOIN (SELECT max(id) AS top FROM {fx.LEDGER} x) m)", palette_idx="long", name="string", id="long"))
def ledger_resolve(spark, sf_dir):
    return typed(led.resolve(fx.names(spark, sf_dir), fx.ledger(spark, sf_dir), max_id=WIDE), palette_idx="long", name="string", id="long")


@query(wanted(f"(SELECT * FROM {fx.LEDGER} l WHERE NOT EXISTS (SELECT 1 FROM {fx.NAMES} n WHERE n.name = l.xkcd_color))", **LEDGER))
def ledger_tombstones(spark, sf_dir):
    return typed(led.tombstones(fx.ledger(spark, sf_dir), fx.names(spark, sf_dir)), **LEDGER)


@query(wanted(f"(SELECT * FROM {fx.LEDGER} l WHERE NOT retired AND NOT EXISTS (SELECT 1 FROM {fx.NAMES} n WHERE n.name = l.xkcd_color))", **LEDGER))
def ledger_newly_retired(spark, sf_dir):
    return typed(led.newly_retired(fx.ledger(spark, sf_dir), fx.names(spark, sf_dir)), **LEDGER)


@query(wanted(f"(SELECT * FROM {fx.LEDGER} l WHERE retired AND EXISTS (SELECT 1 FROM {fx.NAMES} n WHERE n.name = l.xkcd_color))", **LEDGER))
def ledger_reactivated(spark, sf_dir):
    return typed(led.reactivated(fx.ledger(spark, sf_dir), fx.names(spark, sf_dir)), **LEDGER)


def shared_file(spark: SparkSession, name: str) -> str:
    """A new file's path in the shared folder; the driver writes it, so the folder is mounted on the driver."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = "/tmp/checkpoints/huelake"
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        raise ValueError(f"a ledger is written by the driver, which cannot open {folder}")
    os.makedirs(folder, exist_ok=True)
    return f"{folder}/{name}-{uuid.uuid4().hex}.csv"


@query(wanted(fx.LEDGER, **LEDGER))
def ledger_sink(spark, sf_dir):
    """A ledger written as a file, staged and renamed, and its rows read back without its rules."""
    path = shared_file(spark, "ledger-sink")
    led.ledger_sink(fx.ledger(spark, sf_dir), path, WIDE)
    return typed(spark.read.schema(led.SCHEMA).csv(f"file://{path}", header=True, comment="#", multiLine=True, escape='"'), **LEDGER)


@query(ORACLES["ledger_sink"])
def ledger_scan(spark, sf_dir):
    """A ledger's file read with all its checks."""
    path = shared_file(spark, "ledger-scan")
    led.ledger_sink(fx.ledger(spark, sf_dir), path, WIDE)
    return typed(led.ledger_scan(spark, f"file://{path}", max_id=WIDE), **LEDGER)


@query(wanted(q.with_lab("(SELECT * EXCLUDE (name), 'colour ' || palette_idx AS name FROM " + fx.L1 + " t)"), **PALETTE))
def palette_build(spark, sf_dir):
    """The full palette from hierarchy rows and the ledger."""
    rows = fx.palette(spark, sf_dir)
    plain = {f"{kind}_{c}": F.col(c) for kind in ("xkcd", "design", "common") for c in "rgb"}
    named = {f"{kind}_{x}": F.concat(F.lit("colour "), F.col("palette_idx")) for kind, x in (("xkcd", "color"), ("design", "color"), ("common", "color"), ("xkcd", "hex"), ("design", "hex"), ("common", "hex"))}
    words = {"color_family": F.concat(F.lit(" "), "family"), "color_type": F.col("kind"), "color_or_neutral": F.when(F.col("is_neutral"), "neutral").otherwise("color")}
    hierarchy = rows.select("palette_idx", *[e.alias(k) for k, e in {**plain, **named, **words}.items()])
    return typed(pal.build_palette(hierarchy, fx.ledger(spark, sf_dir)), **PALETTE)


_UPDATED = f"""(SELECT id, name AS xkcd_color, false AS retired FROM (SELECT n.name, coalesce(l.id, m.top + row_number() OVER (PARTITION BY l.id IS NULL ORDER BY n.palette_idx)) AS id
FROM {fx.NAMES} n LEFT JOIN {fx.LEDGER} l ON l.xkcd_color = n.name CROSS JOIN (SELECT max(id) AS top FROM {fx.LEDGER} x) m) r
UNION ALL SELECT id, xkcd_color, true FROM {fx.LEDGER} l WHERE NOT EXISTS (SELECT 1 FROM {fx.NAMES} n WHERE n.name = l.xkcd_color))"""


@query(wanted(_UPDATED, **LEDGER))
def ledger_update(spark, sf_dir):
    return typed(led.update(fx.names(spark, sf_dir), fx.ledger(spark, sf_dir), allow_retire_and_mint=True, allow_revival=True, max_id=WIDE), **LEDGER)


#: FNV-1a of 64 bits as a fold over the bytes of all rows, in hexadecimal pairs: two of the id, the name, ff.
_BYTES = f"(SELECT string_agg(printf('%02x%02x', cast(id % 256 AS INTEGER), cast(id // 256 AS INTEGER)) || lower(hex(encode(xkcd_color))) || 'ff', '' ORDER BY id) AS x FROM {fx.LEDGER} l)"
_STEPS = "list_transform(range(0, cast(length(x) // 2 AS BIGINT)), lambda i: cast(cast('0x' || substr(x, cast(2 * i + 1 AS BIGINT), 2) AS INTEGER) AS HUGEINT))"
_FOLD = f"list_reduce(list_prepend(cast(14695981039346656037 AS HUGEINT), {_STEPS}), lambda a, b: (xor(a, b) * cast(1099511628211 AS HUGEINT)) % cast(18446744073709551616 AS HUGEINT))"


@query(f"SELECT '0x' || lower(printf('%08x%08x', cast(v // 4294967296 AS BIGINT), cast(v % 4294967296 AS BIGINT))) AS fingerprint FROM (SELECT {_FOLD} AS v FROM {_BYTES} t) t")
def assignment_fingerprint(spark, sf_dir):
    value = led.assignment_fingerprint(fx.ledger(spark, sf_dir), WIDE)
    return spark.createDataFrame([(f"0x{value:016x}",)], "fingerprint string")
