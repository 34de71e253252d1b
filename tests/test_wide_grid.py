"""Raster queries on a grid of more than 100 cells a side, against plain Python."""

import pytest

from geostrata.plans.catalogue import QUERIES

ROWS, COLS = 121, 151
CELLS = {(r, c): 50.0 + (r * 7 + c * 3) % 40 for r in range(ROWS) for c in range(COLS) if (r < 6 or r > 116) and (c % 9 or r % 3)}
# as row * 100 + col, the first cell is the second one, and the third is next to the fourth
CELLS |= {(0, 150): 110.0, (1, 50): 110.0, (2, 100): 110.0, (2, 99): 90.0, (3, 1): 110.0, (120, 150): 120.0}
SQUARE = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("wide"))
    rows = [(1, c * 20, r, 1, 1.0, v * 1000, 0.1, 0.1) for (r, c), v in CELLS.items()]
    names = ("l_orderkey long", "l_partkey long", "l_suppkey long", "l_linenumber int", "l_quantity double", "l_extendedprice double", "l_discount double", "l_tax double")
    spark.createDataFrame(rows, ", ".join(names)).write.parquet(f"{d}/lineitem.parquet")
    return d


def cells(spark, d, name, value="v"):
    got = QUERIES[name](spark, d).collect()
    assert len({(r.row, r.col) for r in got}) == len(got)
    return {(r.row, r.col): r[value] for r in got}


def test_windows_reach_the_far_edge(spark, wide):
    clamp = lambda k, n: min(max(k, 0), n - 1)
    got = cells(spark, wide, "box_filter3")
    assert got.keys() == CELLS.keys()
    for r, c in CELLS:
        near = [CELLS[p] for a, b in SQUARE if (p := (clamp(r + a, ROWS), clamp(c + b, COLS))) in CELLS]
        assert got[r, c] == pytest.approx(sum(near) / len(near), abs=1e-8)


def test_no_cell_is_cut(spark, wide):
    up = {(r + a, c + b): v for (r, c), v in CELLS.items() if r % 2 == c % 2 == 0 for a in (0, 1) for b in (0, 1) if r + a < ROWS and c + b < COLS}
    assert cells(spark, wide, "pyramid_down_up") == up
    reach = [(a, b) for a in range(-3, 4) for b in range(-3, 4) if (a, b) != (0, 0)]
    hole = {(r + a, c + b) for r, c in CELLS for a, b in reach if 0 <= r + a < ROWS and 0 <= c + b < COLS} - CELLS.keys()
    assert cells(spark, wide, "fill_holes_idw").keys() == hole
    block = {(r // 10, c // 10) for r, c in CELLS}
    assert cells(spark, wide, "dsm_hole_fill").keys() == {(r, c) for r in range(ROWS) for c in range(COLS) if (r // 10, c // 10) in block}
    assert cells(spark, wide, "cloth_dtm").keys() == {(r, c) for r in range(ROWS) for c in range(COLS)}


def test_cells_share_no_number(spark, wide):
    high = {(0, 150), (1, 50), (2, 100), (3, 1), (120, 150)}
    got = cells(spark, wide, "connected_components", "label")
    assert got == {(r, c): r * COLS + c for r, c in high}
    flood = cells(spark, wide, "watershed_objects", "label")
    assert flood == {(r, c): r * COLS + c + 1 for r, c in high}
    assert {r.i: r.v for r in QUERIES["rle_decode"](spark, wide).collect()} == {r * COLS + c: int(v > 80) for (r, c), v in CELLS.items()}
    assert QUERIES["rle_decode"](spark, wide).count() == len(CELLS)
