"""Work in tiles and blocks against plain Python over all cells."""

import random

import pytest
from pyspark.sql import functions as F

from geostrata.operators import raster as rs
from geostrata.plans.catalogue import QUERIES


def cells_of(rng, n, side):
    at = {(rng.randrange(side), rng.randrange(side)) for _ in range(n)}
    return {p: rng.choice([None, 0.0, 5.0, rng.uniform(-9, 9), float("nan")]) if rng.random() < 0.2 else rng.uniform(-9, 9) for p in sorted(at)}


def frame(spark, cells):
    return spark.createDataFrame([(*p, v) for p, v in cells.items()], "row long, col long, v double")


def stat(cells, radius, f):
    key = lambda v: (v != v, v)
    out = {}
    for r, c in cells:
        near = [v for a, b in rs.disk(radius) if (v := cells.get((r + a, c + b))) is not None]
        out[r, c] = f(near, key=key) if near else None
    return out


@pytest.mark.parametrize("radius", [1, 2])
def test_disks_in_tiles(spark, monkeypatch, radius):
    monkeypatch.setattr(rs, "TILE", 16)
    cells = cells_of(random.Random(radius), 900, 60)
    want = cells
    for f in (min, max, max, min):
        want = stat(want, radius, f)
    got = {(r.row, r.col): r.v for r in rs.disk_open_close(frame(spark, cells), radius).collect()}
    assert {p: repr(v) for p, v in got.items()} == {p: repr(v) for p, v in want.items()}


def test_holes_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(rs, "TILE", 16)
    cells = {p: v for p, v in cells_of(random.Random(3), 150, 60).items() if v is None or v == v} | {(41, 0): None, (59, 59): 2.0}
    want = {}
    for r in range(60):
        for c in range(60):
            near = [(v, (a * a + b * b or 1) ** -0.5) for a in range(-3, 4) for b in range(-3, 4) if (r + a, c + b) in cells for v in [cells[r + a, c + b]]]
            if (r, c) not in cells and near:
                some = [v * w for v, w in near if v is not None]
                want[r, c] = sum(some) / sum(w for _, w in near) if some else None
    rows = rs.fill_holes(frame(spark, cells), 60, 60, 3).collect()
    assert len(rows) == len(want) and {(r.row, r.col) for r in rows} == want.keys()
    assert all(r.v == pytest.approx(want[r.row, r.col], abs=1e-9) if r.v is not None else want[r.row, r.col] is None for r in rows)


def test_blocks_are_filled_in_place(spark):
    cells = {p: v for p, v in cells_of(random.Random(5), 60, 47).items() if v is None or v == v}
    least = {}
    for (r, c), v in cells.items():
        k = (r // 10, c // 10)
        least[k] = min([x for x in (v, least.get(k)) if x is not None], default=None)
    want = {(r, c): v if (v := cells.get((r, c))) is not None and v < 4 else least[r // 10, c // 10] for r in range(45) for c in range(47) if (r // 10, c // 10) in least}
    got = rs.fill_blocks(frame(spark, cells), 4, 10, 45, 47).collect()
    assert len(got) == len(want) and {(r.row, r.col): r.v for r in got} == want


@pytest.mark.parametrize("name", ["grey_open_close_disk", "fill_holes_idw", "dsm_hole_fill"])
def test_no_cell_is_spread_by_offsets(spark, name):
    """A grid of two far corners: what is shuffled follows the cells, not the extent or the window."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Join" not in plan and "Range (" not in plan
