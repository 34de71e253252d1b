"""Outlines of labelled cells, edges of rasters, ellipses through points.

Outlines: a cell's sides towards other labels are directed with the cell on their left, so outer loops run
counter-clockwise and holes clockwise. A side's successor begins where it ends; where two cells of a label
touch at a corner only, the turn to the left is taken, which keeps them apart as 4-connection does. Loops are found by
pointer doubling: each round a side learns the least number among twice as many sides ahead, so a loop of n sides takes
log2(n) rounds, whatever its length, and no task walks along one. The order along a loop comes the same way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.operators.components import connected_components
from geostrata.session import discard, materialize

#: Directions 0 to 3: along columns, along rows, and back. A corner's column and row, moved to be positive, take 30 bits each.
STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))
BITS, MIDDLE = 30, 1 << 29
#: tan of 22.5 degrees: where a gradient's direction passes from along an axis to along a diagonal.
TAN_22_5 = 0.41421356237309503


def beside(r: DataFrame, name: str, axis: str, step: int) -> Column:
    """The value of a column one cell further along an axis; null where there is no cell."""
    other = "row" if axis == "col" else "col"
    return F.first(name).over(Window.partitionBy(other).orderBy(axis).rangeBetween(step, step))


def sides(labels: DataFrame) -> DataFrame:
    """(label, id, x, y, dir, next) of the sides of labelled cells (row, col, label): x, y is where a side begins."""
    r = labels.select("row", "col", "label").where(F.col("label").isNotNull()).dropDuplicates(["row", "col"])
    for axis, step, name in (("row", -1, "n0"), ("col", 1, "n1"), ("row", 1, "n2"), ("col", -1, "n3")):
        r = r.withColumn(name, beside(r, "label", axis, step))
    #: begin of each of a cell's sides, from its lower left corner
    begin = ((0, 0), (1, 0), (1, 1), (0, 1))
    each = [F.when(~F.col("label").eqNullSafe(F.col(f"n{k}")), F.struct((F.col("col") + a).alias("x"), (F.col("row") + b).alias("y"), F.lit(k).alias("dir"))) for k, (a, b) in enumerate(begin)]
    out = r.select("label", F.explode(F.filter(F.array(*each), lambda s: s.isNotNull())).alias("s")).select("label", "s.*")
    dx, dy = (F.element_at(F.array(*[F.lit(s[k]) for s in STEPS]), F.col("dir") + 1) for k in (0, 1))
    out = materialize(out.withColumns({"id": side_id("x", "y", "dir"), "ex": F.col("x") + dx, "ey": F.col("y") + dy}), "outline-sides")
    ahead = out.select("label", F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("dir").alias("turn_to"), F.col("id").alias("next"))
    met = out.join(ahead, ["label", "ex", "ey"])
    # left, straight on, right
    rank = F.pmod(F.lit(1) - (F.col("turn_to") - F.col("dir")), F.lit(4))
    return met.groupBy("label", "id", "x", "y", "dir").agg(F.min_by("next", rank).alias("next"))


def side_id(x: str, y: str, k: str) -> Column:
    return F.shiftleft((F.col(y) + MIDDLE).cast("long"), BITS + 2) + F.shiftleft((F.col(x) + MIDDLE).cast("long"), 2) + F.col(k)


def loops(labels: DataFrame) -> DataFrame:
    """(label, loop, seq, x, y, dir) of all sides: loop is the least side number in it, seq counts from that side."""
    s = materialize(sides(labels), "outline-next")
    state = materialize(s.select("id", "next", F.least("id", "next").alias("loop")), "outline-loops")
    while True:
        far = state.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("loop").alias("loop2"))
        new = materialize(state.join(far, "next").select("id", F.col("next2").alias("next"), F.least("loop", "loop2").alias("loop"), (F.col("loop2") < F.col("loop")).alias("moved")), "outline-loops")
        moved = not new.where("moved").isEmpty()
        discard(state)
        state = new.drop("moved")
        if not moved:
            break
    found = materialize(s.join(state.select("id", "loop"), "id"), "outline-found")
    # steps back to the loop's first side, doubled in the same way; None where it is reached
    first = F.col("next") == F.col("loop")
    back = found.select(F.when(first, None).otherwise(F.col("next")).alias("id"), F.col("id").alias("before")).where("id is not null")
    at = found.select("id").join(back, "id", "left").select("id", "before", F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("seq"))
    at = materialize(at, "outline-order")
    while not at.where("before is not null").isEmpty():
        far = at.select(F.col("id").alias("before"), F.col("before").alias("before2"), F.col("seq").alias("seq2"))
        new = materialize(at.join(far, "before", "left").select("id", F.col("before2").alias("before"), (F.col("seq") + F.coalesce("seq2", F.lit(0))).alias("seq")), "outline-order")
        discard(at)
        at = new
    return found.join(at.select("id", "seq"), "id").select("label", "loop", "seq", "x", "y", "dir")


def outlines(sides_in_order: DataFrame) -> DataFrame:
    """(label, loop, k, x, y): corners of loops, sides that go straight on left out, in order from 0."""
    ring = Window.partitionBy("loop").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("dir").over(ring), F.last("dir").over(whole))
    turns = sides_in_order.withColumn("before", before).where("before <> dir")
    return turns.select("label", "loop", (F.row_number().over(ring) - 1).alias("k"), "x", "y")


def loop_measures(sides_in_order: DataFrame) -> DataFrame:
    """(label, loop, n_sides, area): holes have a negative area. Sums only, no order needed."""
    # the area left of the sides: those along columns count the cells between them and row 0
    part = F.when(F.col("dir") == 0, -F.col("y")).when(F.col("dir") == 2, F.col("y")).otherwise(0)
    return sides_in_order.groupBy("label", "loop").agg(F.count(F.lit(1)).alias("n_sides"), F.sum(part).alias("area"))


def gradient(r: DataFrame) -> DataFrame:
    """(row, col, gx, gy) of a raster by 3 x 3 differences; a missing neighbour has the value of the cell next to it."""
    r = r.select("row", "col", "v")
    near = lambda d, name, axis: [F.coalesce(beside(d, name, axis, k), F.col(name)) for k in (-1, 1)]
    w, e = near(r, "v", "col")
    r = r.withColumns({"s": w + 2 * F.col("v") + e, "d": e - w})
    (s0, s1), (d0, d1) = near(r, "s", "row"), near(r, "d", "row")
    return r.select("row", "col", (d0 + 2 * F.col("d") + d1).alias("gx"), (s1 - s0).alias("gy"))


def ridges(r: DataFrame, low: float) -> DataFrame:
    """(row, col, m) of cells whose gradient (sum of absolute parts) is above low and greatest across the edge."""
    g = gradient(r).withColumn("m", F.abs("gx") + F.abs("gy"))
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    g = g.withColumns({"w": zero(beside(g, "m", "col", -1)), "e": zero(beside(g, "m", "col", 1))})
    up = {f"{n}{k}": zero(beside(g, n, "row", s)) for n in ("w", "m", "e") for k, s in ((0, -1), (1, 1))}
    g = g.withColumns(up)
    c, ax, ay = F.col, F.abs("gx"), F.abs("gy")
    flat, steep = ay < ax * F.lit(TAN_22_5), ax < ay * F.lit(TAN_22_5)
    falling = c("gx") * c("gy") < 0
    keep = F.when(flat, (c("m") > c("w")) & (c("m") >= c("e"))).when(steep, (c("m") > c("m0")) & (c("m") >= c("m1")))
    keep = keep.when(falling, (c("m") > c("e0")) & (c("m") > c("w1"))).otherwise((c("m") > c("w0")) & (c("m") > c("e1")))
    return g.where((c("m") > low) & keep).select("row", "col", "m")


def edge_cells(r: DataFrame, low: float, high: float) -> DataFrame:
    """(row, col) of edges: ridges above low that are connected, corners included, with one above high."""
    thin = materialize(ridges(r, low), "edge-ridges")
    cell = thin.select(F.struct("row", "col").alias("a"), "row", "col")
    near = F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    links = cell.select("a", near.alias("b")).join(cell.select(F.col("a").alias("b")), "b", "left_semi")
    number = lambda c: F.shiftleft((F.col(f"{c}.row") + MIDDLE).cast("long"), BITS) + F.col(f"{c}.col") + MIDDLE
    parts = connected_components(links.select(number("a").alias("a"), number("b").alias("b")))
    own = thin.withColumn("id", F.shiftleft((F.col("row") + MIDDLE).cast("long"), BITS) + F.col("col") + MIDDLE).join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    strong = own.where(F.col("m") > high).select("component").distinct()
    return own.join(strong, "component", "left_semi").select("row", "col")


def ellipses(points: DataFrame, group: str) -> DataFrame:
    """(group, n, cx, cy, major, minor, angle) of the ellipse through each group's points (x, y) with least squares.

    One aggregation centres each group, a second sums the moments up to the fourth order; what is left is a
    3 x 3 eigenproblem for each group. Groups of fewer than five points, or whose points lie on no ellipse, give none.
    """
    p = points.dropna(subset=[group, "x", "y"])
    mid = p.groupBy(group).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("size"))
    q = p.join(mid.where("size > 0"), group).select(group, "mx", "my", "size", ((F.col("x") - F.col("mx")) / F.col("size")).alias("x"), ((F.col("y") - F.col("my")) / F.col("size")).alias("y"))
    powers = [(i, j) for i in range(5) for j in range(5 - i)]
    sums = [F.sum(F.pow("x", F.lit(i)) * F.pow("y", F.lit(j))).alias(f"s{i}{j}") for i, j in powers]
    moments = q.groupBy(group, "mx", "my", "size").agg(*sums)
    kind = points.schema[group].dataType.simpleString()

    def solve(parts):
        for pdf in parts:
            rows = [(getattr(r, group), int(r.s00), *found) for r in pdf.itertuples(index=False) if (found := ellipse(r._asdict())) is not None]
            yield pd.DataFrame(rows, columns=[group, "n", "cx", "cy", "major", "minor", "angle"])

    return moments.where("s00 >= 5").mapInPandas(solve, f"`{group}` {kind}, n long, cx double, cy double, major double, minor double, angle double")


def ellipse(m: dict) -> tuple[float, ...] | None:
    """Centre, half axes and angle of the major one from the moments s_ij of centred points."""
    s = lambda i, j: m[f"s{i}{j}"]
    quadratic, linear = ((2, 0), (1, 1), (0, 2)), ((1, 0), (0, 1), (0, 0))
    gram = lambda a, b: np.array([[s(i + k, j + n) for k, n in b] for i, j in a])
    qq, ql, ll = gram(quadratic, quadratic), gram(quadratic, linear), gram(linear, linear)
    try:
        t = -np.linalg.solve(ll, ql.T)
    except np.linalg.LinAlgError:
        return None
    reduced = qq + ql @ t
    # the constraint 4 a c - b^2 = 1 turned into a matrix, inverted by hand
    _, vectors = np.linalg.eig(np.array([reduced[2] / 2, -reduced[1], reduced[0] / 2]))
    vectors = np.real(vectors)
    fit = 4 * vectors[0] * vectors[2] - vectors[1] ** 2
    if not (fit > 1e-12).any():
        return None
    a, b, c = v = vectors[:, fit.argmax()]
    d, e, f = t @ v
    x, y = np.linalg.solve([[2 * a, b], [b, 2 * c]], [-d, -e])
    level = -(f + (d * x + e * y) / 2)
    values, axes = np.linalg.eigh(np.array([[a, b / 2], [b / 2, c]]) / level)
    if not (values > 0).all():
        return None
    angle = float(np.arctan2(axes[1, 0], axes[0, 0]) % np.pi)
    return m["mx"] + m["size"] * x, m["my"] + m["size"] * y, m["size"] / values[0] ** 0.5, m["size"] / values[1] ** 0.5, angle
