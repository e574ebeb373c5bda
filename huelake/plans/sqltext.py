"""DuckDB SQL for the colour arithmetic: each step is a nested SELECT."""

from __future__ import annotations


def add(relation: str, **columns: str) -> str:
    return f"(SELECT *, {', '.join(f'{e} AS {k}' for k, e in columns.items())} FROM {relation} t)"


def linear(c: str) -> str:
    x = f"(cast({c} AS DOUBLE) / cast(255.0 AS DOUBLE))"
    return f"(CASE WHEN {x} <= 0.04045 THEN {x} / cast(12.92 AS DOUBLE) ELSE pow(({x} + cast(0.055 AS DOUBLE)) / cast(1.055 AS DOUBLE), cast(2.4 AS DOUBLE)) END)"


def d(x: float) -> str:
    return f"cast({x!r} AS DOUBLE)"


def lab_f(t: str) -> str:
    return f"(CASE WHEN {t} > {d(216.0)} / {d(24389.0)} THEN cbrt({t}) ELSE {t} * ({d(841.0)} / {d(108.0)}) + {d(4.0)} / {d(29.0)} END)"


def with_lab(relation: str, p: str = "lab_") -> str:
    m = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
    white = (0.95047, 1.0, 1.08883)
    out = add(relation, zr=linear("r"), zg=linear("g"), zb=linear("b"))
    out = add(out, **{f"t{x}": f"(zr * {d(k[0])} + zg * {d(k[1])} + zb * {d(k[2])}) / {d(w)}" for x, k, w in zip("xyz", m, white)})
    out = add(out, fx=lab_f("tx"), fy=lab_f("ty"), fz=lab_f("tz"))
    out = add(out, **{p + "l": f"fy * {d(116.0)} - {d(16.0)}", p + "a": f"(fx - fy) * {d(500.0)}", p + "b": f"(fy - fz) * {d(200.0)}"})
    out = add(out, **{p + "c": f"sqrt({p}a * {p}a + {p}b * {p}b)"})
    return f"(SELECT * EXCLUDE (zr, zg, zb, tx, ty, tz, fx, fy, fz) FROM {out} t)"


def pow7(x: str) -> str:
    return f"(({x}) * ({x}) * (({x}) * ({x})) * (({x}) * ({x})) * ({x}))"


def hue(b: str, a: str) -> str:
    return f"(CASE WHEN {a} = 0 AND {b} = 0 THEN {d(0.0)} WHEN degrees(atan2({b}, {a})) < 0 THEN degrees(atan2({b}, {a})) + {d(360.0)} ELSE degrees(atan2({b}, {a})) END)"


def de76(p: str = "p_", q: str = "q_") -> str:
    return "(" + " + ".join(f"({p}{c} - {q}{c}) * ({p}{c} - {q}{c})" for c in "lab") + ")"


def de94(p: str = "p_", q: str = "q_") -> str:
    dc = f"({p}c - {q}c)"
    sc, sh = f"({p}c * {d(0.045)} + {d(1.0)})", f"({p}c * {d(0.015)} + {d(1.0)})"
    da, db = f"({p}a - {q}a)", f"({p}b - {q}b)"
    return f"(({p}l - {q}l) * ({p}l - {q}l) + ({dc} / {sc}) * ({dc} / {sc}) + greatest({da} * {da} + {db} * {db} - {dc} * {dc}, {d(0.0)}) / ({sh} * {sh}))"


def with_de00(rel: str, out: str = "dist", p: str = "p_", q: str = "q_") -> str:
    z = pow7
    rel = add(rel, m7=z(f"({p}c + {q}c) / {d(2.0)}"))
    rel = add(rel, gg=f"({d(1.0)} - sqrt(m7 / (m7 + {d(6103515625.0)}))) * {d(0.5)}")
    rel = add(rel, a1=f"{p}a * (gg + {d(1.0)})", a2=f"{q}a * (gg + {d(1.0)})")
    rel = add(rel, c1=f"sqrt(a1 * a1 + {p}b * {p}b)", c2=f"sqrt(a2 * a2 + {q}b * {q}b)", h1=hue(f"{p}b", "a1"), h2=hue(f"{q}b", "a2"))
    rel = add(rel, cc="c1 * c2", dh="h2 - h1", hs="h1 + h2", cm=f"(c1 + c2) / {d(2.0)}", lm=f"({p}l + {q}l) / {d(2.0)}")
    rel = add(
        rel,
        dhw=f"CASE WHEN cc = 0 THEN {d(0.0)} WHEN dh > 180 THEN dh - {d(360.0)} WHEN dh < -180 THEN dh + {d(360.0)} ELSE dh END",
        hm=f"CASE WHEN cc = 0 THEN hs WHEN abs(dh) <= 180 THEN hs / {d(2.0)} WHEN hs < 360 THEN (hs + {d(360.0)}) / {d(2.0)} ELSE (hs - {d(360.0)}) / {d(2.0)} END",
        cm7=z("cm"), l50=f"(lm - {d(50.0)}) * (lm - {d(50.0)})",
    )
    rel = add(
        rel,
        tt=f"{d(1.0)} - cos(radians(hm - {d(30.0)})) * {d(0.17)} + cos(radians(hm * {d(2.0)})) * {d(0.24)} + cos(radians(hm * {d(3.0)} + {d(6.0)})) * {d(0.32)} - cos(radians(hm * {d(4.0)} - {d(63.0)})) * {d(0.2)}",
        th=f"exp(-(((hm - {d(275.0)}) / {d(25.0)}) * ((hm - {d(275.0)}) / {d(25.0)}))) * {d(30.0)}", rc=f"sqrt(cm7 / (cm7 + {d(6103515625.0)})) * {d(2.0)}",
        sl=f"{d(1.0)} + l50 * {d(0.015)} / sqrt(l50 + {d(20.0)})", sc=f"cm * {d(0.045)} + {d(1.0)}",
    )
    rel = add(rel, sh=f"cm * {d(0.015)} * tt + {d(1.0)}", dhh=f"sqrt(cc) * {d(2.0)} * sin(radians(dhw / {d(2.0)}))", rt=f"-sin(radians(th * {d(2.0)})) * rc")
    rel = add(rel, xx=f"({q}l - {p}l) / sl", yy="(c2 - c1) / sc", zz="dhh / sh")
    rel = add(rel, **{out: "xx * xx + yy * yy + zz * zz + rt * yy * zz"})
    names = "m7 gg a1 a2 c1 c2 h1 h2 cc dh hs cm lm dhw hm cm7 l50 tt th rc sl sc sh dhh rt xx yy zz".split()
    return f"(SELECT * EXCLUDE ({', '.join(names)}) FROM {rel} t)"
