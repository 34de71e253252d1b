"""Overlapping windows over a raster: split for work on each, and stitched from the windows' middles.

Windows begin every stride cells; the last one ends at the raster's edge, so none is ragged (a raster smaller than a
window has one). A cell's windows follow from its place alone, so splitting is one projection without a join, and in
stitching each cell is taken from the window whose middle is nearest (the earlier one on a tie), again without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count(n: int, size: int, stride: int) -> int:
    """Windows along an axis of n cells."""
    return max(0, -(-(n - size) // stride)) + 1


def start(window: Column, n: int, size: int, stride: int) -> Column:
    """The first cell of a window."""
    return F.least(window * stride, F.lit(max(0, n - size)))


def windows_of(place: Column, n: int, size: int, stride: int) -> Column:
    """All windows that hold a cell, in order."""
    last = count(n, size, stride) - 1
    lo = F.greatest(F.ceil((place - (size - 1)) / F.lit(stride)), F.lit(0)).cast("long")
    hi = F.least(F.floor(place / F.lit(stride)), F.lit(last - 1)).cast("long")
    regular = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    at_edge = F.when(place >= max(0, n - size), F.array(F.lit(last).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(regular, at_edge)


def owner(place: Column, n: int, size: int, stride: int) -> Column:
    """The window whose middle is nearest to a cell."""
    far = lambda w: F.abs(2 * start(w, n, size, stride) + size - 1 - 2 * place)
    return F.array_min(F.transform(windows_of(place, n, size, stride), lambda w: F.struct(far(w).alias("far"), w.alias("w")))).w


def split(raster: DataFrame, rows: int, cols: int, size: int, stride: int) -> DataFrame:
    """Cells (row, col, ...) once for each window (wr, wc) that holds them."""
    wr, wc = windows_of(F.col("row"), rows, size, stride), windows_of(F.col("col"), cols, size, stride)
    return raster.withColumn("wr", F.explode(wr)).withColumn("wc", F.explode(wc))


def stitch(cells: DataFrame, rows: int, cols: int, size: int, stride: int) -> DataFrame:
    """One row a cell, from windowed cells (wr, wc, row, col, ...)."""
    mine = (F.col("wr") == owner(F.col("row"), rows, size, stride)) & (F.col("wc") == owner(F.col("col"), cols, size, stride))
    return cells.where(mine).drop("wr", "wc")
