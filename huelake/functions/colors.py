"""Colour arithmetic as Column expressions, all in DOUBLE and inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# sRGB to XYZ rows, and the D65 white point.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
TWENTY_FIVE_7 = 6103515625.0


def bin_quantize(c: Column) -> Column:
    return F.shiftright(c.cast("int"), 3)


def bin_index(r5: Column, g5: Column, b5: Column) -> Column:
    return r5 * 1024 + g5 * 32 + b5


def bin_center(c5: Column) -> Column:
    return c5 * 8 + 4


def lut_cell(r: Column, g: Column, b: Column) -> Column:
    return bin_index(bin_quantize(r), bin_quantize(g), bin_quantize(b))


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def lab_f(t: Column) -> Column:
    return F.when(t > 216.0 / 24389.0, F.cbrt(t)).otherwise(t * (841.0 / 108.0) + 4.0 / 29.0)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L, a and b of an 8-bit colour."""
    linear = [srgb_to_linear(c.cast("double") / 255.0) for c in (r, g, b)]
    fx, fy, fz = (lab_f((linear[0] * m[0] + linear[1] * m[1] + linear[2] * m[2]) / w) for m, w in zip(XYZ, WHITE))
    return fy * 116.0 - 16.0, (fx - fy) * 500.0, (fy - fz) * 200.0


def with_lab(df, r: str = "r", g: str = "g", b: str = "b", prefix: str = "lab_"):
    """Adds <prefix>l, a, b and c; each step is a projection of its own, so that nothing is computed twice."""
    linear = {f"__{x}": srgb_to_linear(F.col(c).cast("double") / 255.0) for x, c in zip("rgb", (r, g, b))}
    f = {f"__f{x}": lab_f((F.col("__r") * m[0] + F.col("__g") * m[1] + F.col("__b") * m[2]) / w) for x, m, w in zip("xyz", XYZ, WHITE)}
    lab = {prefix + "l": F.col("__fy") * 116.0 - 16.0, prefix + "a": (F.col("__fx") - F.col("__fy")) * 500.0, prefix + "b": (F.col("__fy") - F.col("__fz")) * 200.0}
    out = df.withColumns(linear).withColumns(f).withColumns(lab).drop(*linear, *f)
    return out.withColumn(prefix + "c", lab_chroma(F.col(prefix + "a"), F.col(prefix + "b")))


def lab_chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def delta_e_76_sq(l1: Column, a1: Column, b1: Column, l2: Column, a2: Column, b2: Column) -> Column:
    dl, da, db = l1 - l2, a1 - a2, b1 - b2
    return dl * dl + da * da + db * db


def delta_e_94_sq(l1: Column, a1: Column, b1: Column, c1: Column, l2: Column, a2: Column, b2: Column, c2: Column) -> Column:
    """Colour 1 is the reference."""
    dl, da, db, dc = l1 - l2, a1 - a2, b1 - b2, c1 - c2
    dh = F.greatest(da * da + db * db - dc * dc, F.lit(0.0))
    sc, sh = c1 * 0.045 + 1.0, c1 * 0.015 + 1.0
    return dl * dl + (dc / sc) * (dc / sc) + dh / (sh * sh)


def pow7(x: Column) -> Column:
    return (x * x) * (x * x) * (x * x) * x


def hue_deg(b: Column, a: Column) -> Column:
    angle = F.degrees(F.atan2(b, a))
    return F.when((a == 0) & (b == 0), 0.0).when(angle < 0, angle + 360.0).otherwise(angle)


def with_delta_e_2000(df, one: str, two: str, out: str = "delta_e_2000_sq"):
    """Adds the squared CIEDE2000 of colours with columns <one>l, a, b, c and <two>l, a, b, c."""
    c = F.col
    rad = F.radians
    steps: list[dict[str, Column]] = [
        {"__m7": pow7((c(one + "c") + c(two + "c")) / 2.0)},
        {"__g": (F.lit(1.0) - F.sqrt(c("__m7") / (c("__m7") + TWENTY_FIVE_7))) * 0.5},
        {"__a1": c(one + "a") * (c("__g") + 1.0), "__a2": c(two + "a") * (c("__g") + 1.0)},
        {"__c1": F.sqrt(c("__a1") * c("__a1") + c(one + "b") * c(one + "b")), "__c2": F.sqrt(c("__a2") * c("__a2") + c(two + "b") * c(two + "b")), "__h1": hue_deg(c(one + "b"), c("__a1")), "__h2": hue_deg(c(two + "b"), c("__a2"))},
        {"__cc": c("__c1") * c("__c2"), "__dh": c("__h2") - c("__h1"), "__hs": c("__h1") + c("__h2"), "__cm": (c("__c1") + c("__c2")) / 2.0, "__lm": (c(one + "l") + c(two + "l")) / 2.0},
        {
            "__dhw": F.when(c("__cc") == 0, 0.0).when(c("__dh") > 180, c("__dh") - 360.0).when(c("__dh") < -180, c("__dh") + 360.0).otherwise(c("__dh")),
            "__hm": F.when(c("__cc") == 0, c("__hs")).when(F.abs(c("__dh")) <= 180, c("__hs") / 2.0).when(c("__hs") < 360, (c("__hs") + 360.0) / 2.0).otherwise((c("__hs") - 360.0) / 2.0),
            "__cm7": pow7(c("__cm")), "__l50": (c("__lm") - 50.0) * (c("__lm") - 50.0),
        },
        {
            "__t": F.lit(1.0) - F.cos(rad(c("__hm") - 30.0)) * 0.17 + F.cos(rad(c("__hm") * 2.0)) * 0.24 + F.cos(rad(c("__hm") * 3.0 + 6.0)) * 0.32 - F.cos(rad(c("__hm") * 4.0 - 63.0)) * 0.20,
            "__th": F.exp(-(((c("__hm") - 275.0) / 25.0) * ((c("__hm") - 275.0) / 25.0))) * 30.0,
            "__rc": F.sqrt(c("__cm7") / (c("__cm7") + TWENTY_FIVE_7)) * 2.0,
            "__sl": F.lit(1.0) + c("__l50") * 0.015 / F.sqrt(c("__l50") + 20.0), "__sc": c("__cm") * 0.045 + 1.0,
        },
        {"__sh": c("__cm") * 0.015 * c("__t") + 1.0, "__dhh": F.sqrt(c("__cc")) * 2.0 * F.sin(rad(c("__dhw") / 2.0)), "__rt": -F.sin(rad(c("__th") * 2.0)) * c("__rc")},
        {"__x": (c(two + "l") - c(one + "l")) / c("__sl"), "__y": (c("__c2") - c("__c1")) / c("__sc"), "__z": c("__dhh") / c("__sh")},
        {out: c("__x") * c("__x") + c("__y") * c("__y") + c("__z") * c("__z") + c("__rt") * c("__y") * c("__z")},
    ]
    for step in steps:
        df = df.withColumns(step)
    return df.drop(*[k for step in steps for k in step if k != out])


def parse_color_or_neutral(value: Column) -> Column:
    """True for `neutral`, false for `color`, after trimming; anything else raises."""
    word = F.trim(value)
    return F.when(word == "neutral", True).when(word == "color", False).otherwise(F.raise_error(F.concat(F.lit("not color or neutral: "), F.coalesce(word, F.lit("null")))).cast("boolean"))
