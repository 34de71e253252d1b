"""Outlines against walking along them, edges against a plain loop, ellipses that are planted."""

import math
import random

import numpy as np
import pytest

from geostrata.operators import outlines


def walked(cells):
    """Loops of sides (x, y, dir) of one label by walking, the left turn first."""
    begin = ((0, 0), (1, 0), (1, 1), (0, 1))
    near = ((-1, 0), (0, 1), (1, 0), (0, -1))
    sides = {(c + begin[k][0], r + begin[k][1], k) for r, c in cells for k in range(4) if (r + near[k][0], c + near[k][1]) not in cells}
    out = []
    while sides:
        loop = [min(sides)]
        while True:
            x, y, k = loop[-1]
            x, y = x + outlines.STEPS[k][0], y + outlines.STEPS[k][1]
            after = next((x, y, t % 4) for t in (k + 1, k, k - 1) if (x, y, t % 4) in sides)
            if after == loop[0]:
                break
            loop.append(after)
        sides -= set(loop)
        out.append(loop)
    return out


def turned(loop):
    """The loop from its least side by (y, x, dir)."""
    k = min(range(len(loop)), key=lambda k: (loop[k][1], loop[k][0], loop[k][2]))
    return loop[k:] + loop[:k]


def test_loops_against_walking(spark):
    rng = random.Random(4)
    cells = {(r, c): (1 if rng.random() < 0.6 else 2) for r in range(-3, 9) for c in range(-2, 10) if rng.random() < 0.9}
    cells |= {(30, c): 3 for c in range(100)} | {(40, 40): 4, (41, 41): 4, (42, 40): 4, (41, 39): 4}
    df = spark.createDataFrame([(r, c, v, "x") for (r, c), v in cells.items()] + [(30, 5, 3, "x"), (60, 60, None, "x")], "row long, col long, label int, loop string")
    got = {}
    found = outlines.loops(df).collect()
    for r in sorted(found, key=lambda r: r.seq):
        got.setdefault((r.label, r.loop), []).append((r.x, r.y, r.dir))
    want = sorted((v, turned(loop)) for v in (1, 2, 3, 4) for loop in walked({k for k, w in cells.items() if w == v}))
    assert sorted((v, loop) for (v, _), loop in got.items()) == want
    full = spark.createDataFrame(found)
    area = {}
    for r in outlines.loop_measures(full).collect():
        area[r.label] = area.get(r.label, 0) + r.area
    assert area == {v: sum(w == v for w in cells.values()) for v in (1, 2, 3, 4)}
    line = sorted((r.k, r.x, r.y) for r in outlines.outlines(full).where("label = 3").collect())
    assert line == [(0, 0, 30), (1, 100, 30), (2, 100, 31), (3, 0, 31)]
    assert outlines.loops(df.limit(0)).count() == 0


def plain_edges(v, low, high):
    p = np.pad(v, 1, mode="edge")
    at = lambda a, i, j: a[1 + i : a.shape[0] - 1 + i, 1 + j : a.shape[1] - 1 + j]
    gx = sum(w * (at(p, i, 1) - at(p, i, -1)) for i, w in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(w * (at(p, 1, j) - at(p, -1, j)) for j, w in ((-1, 1), (0, 2), (1, 1)))
    m = np.pad(abs(gx) + abs(gy), 1)
    own, keep = at(m, 0, 0), set()
    for r, c in np.ndindex(*own.shape):
        n = lambda i, j: m[1 + r + i, 1 + c + j]  # noqa: B023,E731
        x, y, g = abs(gx[r, c]), abs(gy[r, c]), own[r, c]
        if y < x * outlines.TAN_22_5:
            top = g > n(0, -1) and g >= n(0, 1)
        elif x < y * outlines.TAN_22_5:
            top = g > n(-1, 0) and g >= n(1, 0)
        else:
            s = -1 if gx[r, c] * gy[r, c] < 0 else 1
            top = g > n(-1, -s) and g > n(1, s)
        if g > low and top:
            keep.add((r, c))
    found = {k for k in keep if own[k] > high}
    todo = list(found)
    while todo:
        r, c = todo.pop()
        more = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & keep - found
        found |= more
        todo += more
    return found


def test_edges_against_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    y, x = np.mgrid[0:24, 0:30]
    v = np.where((x - 14) ** 2 + (y - 11) ** 2 < 60, 50.0, 0) + np.where(x + y > 40, 20.0, 0) + rng.normal(size=x.shape)
    df = spark.createDataFrame([(int(r), int(c), float(v[r, c])) for r, c in np.ndindex(*v.shape)], "row long, col long, v double")
    for low, high in ((20, 120), (10, 60), (5, 1000)):
        got = {(r.row, r.col) for r in outlines.edge_cells(df, low, high).collect()}
        assert got == plain_edges(v, low, high) and (high == 1000) == (not got)


def test_ellipses(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for g in range(8):
        cx, cy, a, b, t = rng.uniform(-1e4, 1e4), rng.uniform(-1e4, 1e4), rng.uniform(5, 9), rng.uniform(1, 4), rng.uniform(0, math.pi)
        want[g] = (cx, cy, a, b, t)
        for _ in range(5 + g):
            s = rng.uniform(0, 2 * math.pi)
            rows.append((g, cx + a * math.cos(s) * math.cos(t) - b * math.sin(s) * math.sin(t), cy + a * math.cos(s) * math.sin(t) + b * math.sin(s) * math.cos(t)))
    rows += [(20, 1.0, 1.0)] * 9 + [(21, float(k), float(k)) for k in range(9)] + [(22, 0.0, 1.0)] * 3 + [(23, None, 1.0), (None, 1.0, 2.0)]
    got = {r.g: r for r in outlines.ellipses(spark.createDataFrame(rows, "g int, x double, y double"), "g").collect()}
    assert set(got) == set(want)
    for g, w in want.items():
        assert (got[g].cx, got[g].cy, got[g].major, got[g].minor, got[g].angle) == pytest.approx(w, rel=1e-6) and got[g].n == 5 + g
