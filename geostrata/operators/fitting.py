"""Fits from aggregated moments, hulls and rectangles, mesh bookkeeping, camera inversion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.functions.camera import Camera
from geostrata.operators.components import connected_components


def moments(points: DataFrame, key: str) -> DataFrame:
    """Means and covariances by key: one aggregation, whatever the number of points."""
    pairs = [(a, b) for k, a in enumerate("xyz") for b in "xyz"[k:]]
    return points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"c{a}") for a in "xyz"], *[(F.var_pop(a) if a == b else F.covar_pop(a, b)).alias(a + b) for a, b in pairs])


def planes(points: DataFrame, key: str) -> DataFrame:
    """(key, a, b, c, d): the plane of least squared distances, from the covariance's smallest axis."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for m in it:
            cov = m[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy(float).reshape(-1, 3, 3)
            n = np.linalg.eigh(cov)[1][:, :, 0] if len(m) else np.empty((0, 3))
            n = n * np.where(n[:, 2] < 0, -1, 1)[:, None]
            off = -(n * m[["cx", "cy", "cz"]].to_numpy(float)).sum(axis=1)
            yield pd.DataFrame({key: m[key], "a": n[:, 0], "b": n[:, 1], "c": n[:, 2], "d": off})

    kind = points.schema[key].dataType.simpleString()
    return moments(points, key).mapInPandas(run, f"{key} {kind}, a double, b double, c double, d double")


def quadratic(points: DataFrame, key: str) -> DataFrame:
    """(key, c0, c1, c2) of y = c0 + c1 x + c2 x^2 by normal equations and Cramer's rule."""
    x, y = F.col("x"), F.col("y")
    sums = {"n": F.count(F.lit(1)).cast("double"), "s1": F.sum(x), "s2": F.sum(x * x), "s3": F.sum(x * x * x), "s4": F.sum(x * x * x * x), "t0": F.sum(y), "t1": F.sum(x * y), "t2": F.sum(x * x * y)}
    g = points.groupBy(key).agg(*[v.alias(k) for k, v in sums.items()])
    col = F.col

    def det(a: list[str]) -> object:
        p, q, r, s, t, u, v, w, z = (col(n) for n in a)
        return p * (t * z - u * w) - q * (s * z - u * v) + r * (s * w - t * v)

    whole = det(["n", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4"])
    parts = (["t0", "s1", "s2", "t1", "s2", "s3", "t2", "s3", "s4"], ["n", "t0", "s2", "s1", "t1", "s3", "s2", "t2", "s4"], ["n", "s1", "t0", "s1", "s2", "t1", "s2", "s3", "t2"])
    return g.select(key, *[F.try_divide(det(p), whole).alias(f"c{k}") for k, p in enumerate(parts)])


def hull(p: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by the monotone chain."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def min_rectangle(p: np.ndarray) -> tuple[float, float, float, float, float]:
    """(area, angle, length, width, share of the ring's hull) of the least rectangle around points: one side lies on a hull edge."""
    h = hull(p)
    if len(h) < 3:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    e = np.roll(h, -1, axis=0) - h
    best = None
    for a in np.arctan2(e[:, 1], e[:, 0]):
        u, v = h @ np.array([np.cos(a), np.sin(a)]), h @ np.array([-np.sin(a), np.cos(a)])
        size = (np.ptp(u) * np.ptp(v), a % np.pi, np.ptp(u), np.ptp(v))
        best = size if best is None or size[0] < best[0] else best
    inner = abs(np.sum(h[:, 0] * np.roll(h[:, 1], -1) - np.roll(h[:, 0], -1) * h[:, 1])) / 2
    return (*best, inner / best[0] if best[0] else 0.0)


def min_area_rectangles(rings: DataFrame) -> DataFrame:
    """(id, area, angle, length, width, share) of rings (id, r)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(i, *min_rectangle(np.array([(q["x"], q["y"]) for q in r]))) for i, r in zip(pdf["id"], pdf["r"])]
            yield pd.DataFrame(rows, columns=["id", "area", "angle", "length", "width", "share"])

    return rings.mapInPandas(run, f"id {rings.schema['id'].dataType.simpleString()}, area double, angle double, length double, width double, share double")


def vertex_offsets(files: DataFrame) -> DataFrame:
    """(file, nv, base): vertices in the files before, by name; one row a file."""
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("nv").over(w), F.lit(0)))


def face_components(corners: DataFrame) -> DataFrame:
    """(id, component) of faces that share a vertex, from rows (vertex, face): edges go to each vertex's least face."""
    first = corners.groupBy("vertex").agg(F.min("face").alias("a"))
    edges = corners.join(first, "vertex").where("face <> a").select("a", F.col("face").alias("b")).distinct()
    return connected_components(edges)


def back_projected(world: DataFrame, camera: Camera) -> DataFrame:
    """(pid, error): distance in degrees between each point and its back-projected image, at its altitude."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            p = pdf[["lon", "lat", "alt"]].to_numpy(float)
            q = camera.back_project_numpy(camera.project_numpy(p), p[:, 2])
            yield pd.DataFrame({"pid": pdf["pid"], "error": np.abs(q - p[:, :2]).max(axis=1) if len(p) else []})

    return world.mapInPandas(run, f"pid {world.schema['pid'].dataType.simpleString()}, error double")
