"""Median cut against an independent splitter that works on lists of pixels."""

import random

import numpy as np
import pytest

from huelake.operators import mmcq


def inside(px, box):
    return [p for p in px if all(lo <= v <= hi for v, (lo, hi) in zip(p, box))]


def halves(px, box):
    """The two boxes of a cut, or None. px: pixels in 5-bit channels; box: (low, high) of each channel."""
    mine = inside(px, box)
    widths = [hi - lo for lo, hi in box]
    if len(mine) <= 1 or max(widths) == 0:
        return None
    axis = max(range(3), key=lambda k: (widths[k], -k))
    lo, hi = box[axis]
    upto = {v: sum(p[axis] <= v for p in mine) for v in range(lo, hi + 1)}
    middle = next((v for v in range(lo, hi + 1) if upto[v] > len(mine) // 2), None)
    if middle is None:
        return None
    if middle - lo <= hi - middle:
        cut = min(middle + (hi - middle) // 2, hi - 1)
    else:
        cut = max(middle - 1 - (middle - lo) // 2, lo)
    cut = min(max(cut, lo), hi)
    while cut < hi and upto[cut] == 0:
        cut += 1
    while cut > lo and upto[cut] == len(mine) and upto[cut - 1] != 0:
        cut -= 1
    cut = max(min(cut, hi - 1), lo)
    return [b if k != axis else (lo, cut) for k, b in enumerate(box)], [b if k != axis else (cut + 1, hi) for k, b in enumerate(box)]


def cut_until(px, boxes, target, score):
    waiting = []
    rounds = 0
    while len(boxes) + len(waiting) < target and boxes and rounds < 1000:
        rounds += 1
        boxes = sorted(boxes, key=score)
        box = boxes.pop()
        if not inside(px, box):
            break
        two = halves(px, box)
        if two is None:
            waiting.append(box)
        else:
            boxes += [b for b in two if inside(px, b)]
    while waiting:
        boxes = [*boxes, waiting.pop()]
    return boxes


def slow_dominants(px, count):
    if count <= 0 or not px:
        return []
    first = [(min(p[k] for p in px), max(p[k] for p in px)) for k in range(3)]
    target = min(max(count, 2), 256)
    size = lambda b: len(inside(px, b))
    volume = lambda b: np.prod([hi - lo + 1 for lo, hi in b]).item()
    boxes = cut_until(px, [first], (3 * target + 3) // 4, size)
    boxes = cut_until(px, boxes, target, lambda b: size(b) * volume(b))
    out = []
    for b in sorted(boxes, key=size, reverse=True):
        mine = inside(px, b)
        if mine and len(out) < count:
            out.append((tuple(sum(p[k] * 8 + 4 for p in mine) // len(mine) for k in range(3)), len(mine), 100.0 * len(mine) / len(px)))
    return out


def frame(rng, kind):
    n = rng.randint(1, 90)
    if kind == "noise":
        return [tuple(rng.randrange(256) for _ in range(3)) for _ in range(n)]
    if kind == "line":
        return [(rng.randrange(256), 7, 7) for _ in range(n)]
    centres = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(rng.randint(1, 6))]
    return [tuple(min(255, max(0, v + rng.randint(-12, 12))) for v in rng.choice(centres)) for _ in range(n)]


@pytest.mark.parametrize("kind", ["noise", "line", "clusters"])
@pytest.mark.parametrize("count", range(1, 21))
def test_dominants_equal_brute_force(kind, count):
    rng = random.Random(f"{kind}{count}")
    for _ in range(6):
        px = frame(rng, kind)
        a = np.array(px) >> 3
        hist = mmcq._dense((a[:, 0] << 10) | (a[:, 1] << 5) | a[:, 2])
        made = mmcq.dominant_boxes(hist, count)
        assert [(d[0], d[1]) for d in made] == [(d[0], d[1]) for d in slow_dominants([tuple(p) for p in a.tolist()], count)]
        assert [d[2] for d in made] == pytest.approx([d[2] for d in slow_dominants([tuple(p) for p in a.tolist()], count)])
