"""Spheres and cylinders in point clouds with normals, by random consensus, one after the other.

Hypotheses are rows: of each group the points of the least seeded hashes are paired, and the lines along the two
normals give a shape (their nearest points, and the axis across both). All points of a group are held against all
its hypotheses in one join, whose counts are aggregated before any shuffle; the hypothesis with the most inliers wins.
Its inliers leave, and the rest is searched again, until no group has a shape with enough inliers. So no group
is ever held in one task, and a round costs points times hypotheses, whatever the shapes.

Nulls: points with a null value take no part. Hypotheses are bounded by a parameter; ties go to the smaller number. Repeated
points each count. A group of fewer points than min_points gives none, as does an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.session import materialize

PLACE, NORMAL = ("x", "y", "z"), ("nx", "ny", "nz")
#: Hypotheses up to which they are broadcast; beyond, they meet the points by group.
MAX_BROADCAST = 100_000
SHAPE = ["cx", "cy", "cz", "ax", "ay", "az", "radius"]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def away(kind: str, p: list[Column], c: list[Column], a: list[Column]) -> Column:
    """Distance of a point from a sphere's centre or a cylinder's axis (of length 1)."""
    v = [x - y for x, y in zip(p, c)]
    if kind == "cylinder":
        v = cross(v, a)
    return F.sqrt(dot(v, v))


def cols(prefix: str, names: tuple[str, ...]) -> list[Column]:
    return [F.col(f"{prefix}{n}") for n in names]


def hypotheses(points: DataFrame, group: str, kind: str, n: int, seed: int, radius: tuple[float, float]) -> DataFrame:
    """(group, k, shape) from pairs of points: at most n a group."""
    order = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    some = points.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * n)
    k, side = F.floor((F.col("rank") - 1) / 2), F.col("rank") % 2
    pick = lambda want, s: [F.max(F.when(side == want, F.col(c))).alias(f"{s}{c}") for c in (*PLACE, *NORMAL)]
    pairs = some.groupBy(group, k.alias("k")).agg(*pick(1, "p"), *pick(0, "q")).dropna()
    p, q, u, v = cols("p", PLACE), cols("q", PLACE), cols("p", NORMAL), cols("q", NORMAL)
    w = [a - b for a, b in zip(p, q)]
    uu, uv, vv, uw, vw = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    det = uu * vv - uv * uv
    # nearly parallel normals say nothing about a centre
    pairs = pairs.withColumns({"s": F.when(det > uu * vv * 1e-6, (uv * vw - vv * uw) / det), "t": F.when(det > uu * vv * 1e-6, (uu * vw - uv * uw) / det)}).where("s is not null")
    on_p, on_q = [a + F.col("s") * b for a, b in zip(p, u)], [a + F.col("t") * b for a, b in zip(q, v)]
    axis = cross(u, v)
    size = F.sqrt(dot(axis, axis))
    shape = {f"c{n}": (a + b) / 2 for n, a, b in zip("xyz", on_p, on_q)} | {f"a{n}": F.try_divide(a, size) for n, a in zip("xyz", axis)}
    out = pairs.withColumns(shape)
    c, a = cols("c", PLACE), cols("a", PLACE)
    out = out.withColumn("radius", (away(kind, p, c, a) + away(kind, q, c, a)) / 2)
    return out.where(F.col("radius").between(*radius)).select(group, "k", *SHAPE)


def shapes(points: DataFrame, group: str, kind: str, n: int = 100, tolerance: float = 0.05, radius: tuple[float, float] = (0.0, 1e9), min_points: int = 10, min_share: float = 0.0, seed: int = 42, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(group, round, shape, n_inliers) and the points that belong to no shape.

    A shape has at least min_points inliers, and min_share of its group's points. points: group, id, x, y, z, nx, ny, nz. kind: sphere or cylinder (its a is the axis; a sphere's has no meaning).
    """
    left = materialize(points.select(group, "id", *PLACE, *NORMAL).dropna(), "consensus-points")
    c, a, p = cols("c", PLACE), cols("a", PLACE), cols("", PLACE)
    near = F.abs(away(kind, p, c, a) - F.col("radius")) <= tolerance
    sizes = materialize(left.groupBy(group).agg(F.count(F.lit(1)).alias("size")), "consensus-sizes")
    found = None
    for k in range(rounds):
        h = materialize(hypotheses(left, group, kind, n, seed + k, radius), "consensus-hypotheses")
        side = F.broadcast(h) if h.count() <= MAX_BROADCAST else h
        counts = left.join(side, group).where(near).groupBy(group, "k").agg(F.count(F.lit(1)).alias("n_inliers"))
        counts = counts.join(sizes, group).where((F.col("n_inliers") >= min_points) & (F.col("n_inliers") >= F.col("size") * min_share))
        best = counts.groupBy(group).agg(F.max(F.struct("n_inliers", (-F.col("k")).alias("k"))).alias("m")).select(group, (-F.col("m.k")).alias("k"), "m.n_inliers")
        best = materialize(best.join(h, [group, "k"]).select(group, F.lit(k).alias("round"), *SHAPE, "n_inliers"), "consensus-best")
        if best.isEmpty():
            break
        found = best if found is None else found.unionByName(best)
        # one shape a group at most, so the join keeps every other point once
        side = best.select(group, *SHAPE)
        left = materialize(left.join(side, group, "left").where(~F.coalesce(near, F.lit(False))).select(group, "id", *PLACE, *NORMAL), "consensus-points")
    return (best if found is None else found), left
