"""The same arithmetic on numpy arrays, for the Arrow paths. Palettes are (n, 4) arrays of L, a, b, chroma."""

from __future__ import annotations

import numpy as np

from .algorithm import Algorithm
from .colors import TWENTY_FIVE_7, WHITE, XYZ


def rgb_to_lab(rgb: np.ndarray) -> np.ndarray:
    """(n, 4) of L, a, b and chroma from (n, 3) 8-bit values."""
    c = rgb.astype(np.float64) / 255.0
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = np.stack([(linear[:, 0] * m[0] + linear[:, 1] * m[1] + linear[:, 2] * m[2]) / w for m, w in zip(XYZ, WHITE)], axis=1)
    f = np.where(xyz > 216.0 / 24389.0, np.cbrt(xyz), xyz * (841.0 / 108.0) + 4.0 / 29.0)
    a, b = (f[:, 0] - f[:, 1]) * 500.0, (f[:, 1] - f[:, 2]) * 200.0
    return np.stack([f[:, 1] * 116.0 - 16.0, a, b, np.sqrt(a * a + b * b)], axis=1)


def delta_e_76_sq(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    d = one - two
    return d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]


def delta_e_94_sq(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    dl, da, db, dc = (one[..., k] - two[..., k] for k in range(4))
    dh = np.maximum(da * da + db * db - dc * dc, 0.0)
    sc, sh = one[..., 3] * 0.045 + 1.0, one[..., 3] * 0.015 + 1.0
    return dl * dl + (dc / sc) * (dc / sc) + dh / (sh * sh)


def _pow7(x: np.ndarray) -> np.ndarray:
    return (x * x) * (x * x) * (x * x) * x


def _hue(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    h = np.degrees(np.arctan2(b, a))
    return np.where((a == 0) & (b == 0), 0.0, np.where(h < 0, h + 360.0, h))


def delta_e_2000_sq(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    m7 = _pow7((one[..., 3] + two[..., 3]) / 2.0)
    g = (1.0 - np.sqrt(m7 / (m7 + TWENTY_FIVE_7))) * 0.5
    a1, a2 = one[..., 1] * (g + 1.0), two[..., 1] * (g + 1.0)
    b1, b2 = one[..., 2], two[..., 2]
    c1, c2 = np.sqrt(a1 * a1 + b1 * b1), np.sqrt(a2 * a2 + b2 * b2)
    h1, h2 = _hue(b1, a1), _hue(b2, a2)
    cc, dh, hs, cm, lm = c1 * c2, h2 - h1, h1 + h2, (c1 + c2) / 2.0, (one[..., 0] + two[..., 0]) / 2.0
    wrapped = np.where(cc == 0, 0.0, np.where(dh > 180, dh - 360.0, np.where(dh < -180, dh + 360.0, dh)))
    hm = np.where(cc == 0, hs, np.where(np.abs(dh) <= 180, hs / 2.0, np.where(hs < 360, (hs + 360.0) / 2.0, (hs - 360.0) / 2.0)))
    rad = np.radians
    t = 1.0 - np.cos(rad(hm - 30.0)) * 0.17 + np.cos(rad(hm * 2.0)) * 0.24 + np.cos(rad(hm * 3.0 + 6.0)) * 0.32 - np.cos(rad(hm * 4.0 - 63.0)) * 0.20
    cm7, l50 = _pow7(cm), (lm - 50.0) * (lm - 50.0)
    theta = np.exp(-(((hm - 275.0) / 25.0) * ((hm - 275.0) / 25.0))) * 30.0
    rc = np.sqrt(cm7 / (cm7 + TWENTY_FIVE_7)) * 2.0
    x = (two[..., 0] - one[..., 0]) / (1.0 + l50 * 0.015 / np.sqrt(l50 + 20.0))
    y = (c2 - c1) / (cm * 0.045 + 1.0)
    z = np.sqrt(cc) * 2.0 * np.sin(rad(wrapped / 2.0)) / (cm * 0.015 * t + 1.0)
    return x * x + y * y + z * z - np.sin(rad(theta * 2.0)) * rc * y * z


METRICS = {Algorithm.DELTA_E_76: delta_e_76_sq, Algorithm.CIE94: delta_e_94_sq, Algorithm.CIEDE2000: delta_e_2000_sq, Algorithm.CIEDE2000_EXACT: delta_e_2000_sq}
#: Colours that are compared with a whole palette at once.
ROWS = 512


def nearest_index(rgb: np.ndarray, palette_lab: np.ndarray, algorithm: Algorithm) -> np.ndarray:
    """Index of the nearest palette entry of each colour; the lowest index wins ties."""
    metric = METRICS[algorithm]
    lab = rgb_to_lab(rgb)
    out = np.empty(len(rgb), dtype=np.int64)
    for i in range(0, len(rgb), ROWS):
        out[i : i + ROWS] = metric(palette_lab[None, :, :], lab[i : i + ROWS, None, :]).argmin(axis=1)
    return out
