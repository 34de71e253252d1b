"""Rasters in pixel form (row, col, v): gridding, alignment, windows, morphology, pyramids, labels.

All work on sparse long tables; a missing row is no data. Windows over a raster's row or column are
range windows, so gaps count as gaps and one task holds one line of the raster at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.operators.components import connected_components

CELL = ["row", "col"]
#: Cells a side of the tiles that a task holds at once.
TILE = 256


def grid_stat(points: DataFrame, dx: float, dy: float, stats: dict[str, Column], x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Statistics of the points in each cell; every point is in one cell."""
    row, col = F.floor((F.col("y") - F.lit(y0)) / F.lit(dy)).alias("row"), F.floor((F.col("x") - F.lit(x0)) / F.lit(dx)).alias("col")
    return points.groupBy(row, col).agg(*[c.alias(n) for n, c in stats.items()])


def crop(points: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Points inside closed ranges by dimension; reaches the scan as pushed filters."""
    for name, (lo, hi) in bounds.items():
        points = points.where(F.col(name).between(lo, hi))
    return points


def clip_to(points: DataFrame, by: DataFrame) -> DataFrame:
    """Points inside the x and y range of another table of points (one row of bounds is broadcast)."""
    b = by.agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"))
    return points.join(F.broadcast(b), F.col("x").between(F.col("lx"), F.col("hx")) & F.col("y").between(F.col("ly"), F.col("hy"))).drop("lx", "hx", "ly", "hy")


def align(a: DataFrame, b: DataFrame, value: Column) -> DataFrame:
    """value over the cells that both rasters (columns a, b) have."""
    return a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), CELL).select(*CELL, value.alias("v"))


def fill_from(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of b with a's values where a has them."""
    return b.withColumnRenamed("v", "b").join(a.withColumnRenamed("v", "a"), CELL, "left").select(*CELL, F.coalesce("a", "b").alias("v"))


def line_window(axis: str, radius: int):
    other = "row" if axis == "col" else "col"
    return Window.partitionBy(other).orderBy(axis).rangeBetween(-radius, radius)


def square_max(r: DataFrame, radius: int) -> DataFrame:
    """Largest value in the square around each cell: two passes of range windows, so linear in the radius at most."""
    return r.withColumn("v", F.max("v").over(line_window("col", radius))).withColumn("v", F.max("v").over(line_window("row", radius)))


def square_min(r: DataFrame, radius: int) -> DataFrame:
    return r.withColumn("v", F.min("v").over(line_window("col", radius))).withColumn("v", F.min("v").over(line_window("row", radius)))


def opened(r: DataFrame, radius: int = 1) -> DataFrame:
    return square_max(square_min(r, radius), radius)


def closed(r: DataFrame, radius: int = 1) -> DataFrame:
    return square_min(square_max(r, radius), radius)


def spread(r: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Every value at the cells that see it through the offsets: (row, col, v) with repeats."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets]))
    return r.withColumn("o", o).select((F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"), "v")


def disk(radius: float) -> list[tuple[int, int]]:
    n = int(radius)
    return [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if a * a + b * b <= radius * radius]


def by_tiles(r: DataFrame, halo: int, run: Callable, tile: int) -> DataFrame:
    """(row, col, v) of tiles. Every cell goes to the tiles that it lies in or at most halo away from: one shuffle, few repeats.

    run(v, there, known, r0, c0) gets arrays of a tile and its halo, whose first cell is (r0, c0): values, whether a cell is there, whether
    its value isn't null. It gives rows, columns (both in the arrays), values and which of them aren't null.
    """
    side = tile + 2 * halo

    def one(key: tuple, table: pa.Table) -> pa.Table:
        r0, c0 = (k.as_py() * tile - halo for k in key)
        i, j = table["row"].to_numpy() - r0, table["col"].to_numpy() - c0
        v, there, known = np.zeros((side, side)), np.zeros((side, side), bool), np.zeros((side, side), bool)
        there[i, j], known[i, j] = True, table["v"].is_valid().to_numpy()
        v[i, j] = table["v"].fill_null(0.0).to_numpy()
        i, j, out, valid = run(v, there, known, r0, c0)
        return pa.table({"row": i + r0, "col": j + c0, "v": pa.array(out, mask=~valid)})

    at = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
    cells = r.where("row is not null and col is not null").select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("v").cast("double"))
    return cells.withColumn("tr", at("row")).withColumn("tc", at("col")).groupBy("tr", "tc").applyInArrow(one, "row long, col long, v double")


def shifted(a: np.ndarray, n: int, offsets: list[tuple[int, int]], fill: float) -> Iterator[np.ndarray]:
    """The array as seen through each offset of at most n; fill outside."""
    p = np.pad(a, n, constant_values=fill)
    for i, j in offsets:
        yield p[n + i : n + i + a.shape[0], n + j : n + j + a.shape[1]]


def disk_open_close(r: DataFrame, radius: float) -> DataFrame:
    """Grey opening, then closing, with a disk around each existing cell; all four passes in tiles."""
    n, offsets = int(radius), disk(radius)

    def run(v: np.ndarray, there: np.ndarray, known: np.ndarray, r0: int, c0: int) -> tuple:
        # only the order of values counts: NaN comes last in it, as in Spark
        order, rank = np.unique(v[known], return_inverse=True)
        none, a = len(order), np.full(v.shape, -1, np.int32)
        a[known] = rank
        for least in (True, False, False, True):
            a = np.where(a < 0, none, a) if least else a
            b, meet = a, np.minimum if least else np.maximum
            for other in shifted(a, n, offsets, none if least else -1):
                b = meet(b, other)
            a = np.where(there & (b < none), b, -1)
        i, j = np.nonzero(there[4 * n : v.shape[0] - 4 * n, 4 * n : v.shape[1] - 4 * n])
        i, j = i + 4 * n, j + 4 * n
        got = a[i, j]
        return i, j, np.append(order, 0.0)[got], got >= 0

    return by_tiles(r, 4 * n, run, TILE)


def box_mean3(r: DataFrame, rows: int, cols: int) -> DataFrame:
    """Mean of the 3 x 3 window, the border reflected at the edge (a cell outside takes the edge cell's value)."""
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    offs = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offs]))
    asks = r.select(*CELL).withColumn("o", o).select(*CELL, clamp(F.col("row") + F.col("o.a"), rows).alias("r2"), clamp(F.col("col") + F.col("o.b"), cols).alias("c2"))
    return asks.join(r.select(F.col("row").alias("r2"), F.col("col").alias("c2"), "v"), ["r2", "c2"]).groupBy(*CELL).agg(F.avg("v").alias("v"))


def down2(r: DataFrame) -> DataFrame:
    """Every second cell."""
    return r.where("row % 2 = 0 and col % 2 = 0").select((F.col("row") / 2).cast("long").alias("row"), (F.col("col") / 2).cast("long").alias("col"), "v")


def up2(small: DataFrame, rows: int, cols: int) -> DataFrame:
    """Each cell four times; rows and cols bound the result, so odd sizes fit."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    out = small.withColumn("o", o).select((F.col("row") * 2 + F.col("o.a")).alias("row"), (F.col("col") * 2 + F.col("o.b")).alias("col"), "v")
    return out.where((F.col("row") < rows) & (F.col("col") < cols))


def dilate_black(r: DataFrame, radius: int = 2) -> DataFrame:
    """Grey dilation that changes cells of value 0 only."""
    m = F.max("v").over(line_window("col", radius))
    wide = r.withColumn("m", m).withColumn("m", F.max("m").over(line_window("row", radius)))
    return wide.select(*CELL, F.when(F.col("v") == 0, F.col("m")).otherwise(F.col("v")).alias("v"))


def fill_holes(r: DataFrame, rows: int, cols: int, radius: int) -> DataFrame:
    """Missing cells take the inverse-distance mean of cells within a square of the radius, where there are any."""
    offsets = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if (a, b) != (0, 0)]

    def run(v: np.ndarray, there: np.ndarray, known: np.ndarray, r0: int, c0: int) -> tuple:
        near = np.zeros(v.shape, np.int32)
        for other in shifted(there.astype(np.int32), radius, offsets, 0):
            near += other
        hole = ~there & (near > 0)
        hole[:radius], hole[-radius:], hole[:, :radius], hole[:, -radius:] = False, False, False, False
        i, j = np.nonzero(hole)
        inside = (i + r0 >= 0) & (i + r0 < rows) & (j + c0 >= 0) & (j + c0 < cols)
        i, j = i[inside], j[inside]
        total, weight, n = np.zeros(len(i)), np.zeros(len(i)), np.zeros(len(i), np.int32)
        for a, b in offsets:
            w = 1 / (a * a + b * b) ** 0.5
            k = i + a, j + b
            total += v[k] * w
            weight += there[k] * w
            n += known[k]
        return i, j, total / weight, n > 0

    return by_tiles(r, radius, run, TILE)


def fill_blocks(r: DataFrame, below: float, size: int, rows: int, cols: int) -> DataFrame:
    """All cells of the blocks of size x size that have any: the cell's own value where that is below a limit, else the block's least value.

    A block's cells are at most size * size values; the others are made from them in place, so only existing cells are shuffled.
    """
    c = F.col
    cells = r.where((c("row") >= 0) & (c("col") >= 0)).withColumns({"gr": F.floor(c("row") / size), "gc": F.floor(c("col") / size)})
    own = F.when(c("v") < below, F.struct(((c("row") % size) * size + c("col") % size).cast("int").alias("at"), "v"))
    blocks = cells.groupBy("gr", "gc").agg(F.min("v").alias("g"), F.collect_list(own).alias("own"))
    rest = F.array_except(F.sequence(F.lit(0), F.lit(size * size - 1)), F.transform("own", lambda p: p["at"]))
    every = F.concat("own", F.transform(rest, lambda k: F.struct(k.alias("at"), c("g").alias("v"))))
    out = blocks.select("gr", "gc", F.inline(every)).select((c("gr") * size + F.floor(c("at") / size)).alias("row"), (c("gc") * size + c("at") % size).alias("col"), "v")
    return out.where((c("row") < rows) & (c("col") < cols))


def labels4(mask: DataFrame, cols: int) -> DataFrame:
    """Components of cells that touch along an edge: (row, col, label), the label the least row * cols + col."""
    cell = mask.select(*CELL, (F.col("row") * cols + F.col("col")).alias("id"))
    edges = None
    for a, b in ((0, 1), (1, 0)):
        other = cell.select((F.col("row") - a).alias("row"), (F.col("col") - b).alias("col"), F.col("id").alias("b"))
        e = cell.withColumnRenamed("id", "a").join(other, CELL).select("a", "b")
        edges = e if edges is None else edges.unionByName(e)
    return cell.join(connected_components(edges), "id", "left").select(*CELL, F.coalesce("component", "id").alias("label"))


def drop_small(labelled: DataFrame, least: int) -> DataFrame:
    """Cells of components of at least so many cells."""
    keep = labelled.groupBy("label").count().where(F.col("count") >= least).select("label")
    return labelled.join(keep, "label", "left_semi")


def elongation(labelled: DataFrame) -> DataFrame:
    """(label, n, large, small): scales of a component along its two axes, sqrt(12 * eigenvalue of its covariance)."""
    g = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.var_pop("row").alias("a"), F.var_pop("col").alias("c"), F.covar_pop("row", "col").alias("b"))
    half, root = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, F.lit(2.0)) + F.col("b") * F.col("b"))
    return g.select("label", "n", F.sqrt(12 * (half + root)).alias("large"), F.sqrt(12 * F.greatest(half - root, F.lit(0.0))).alias("small"))
