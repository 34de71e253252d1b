"""Covariance of points from an error model: interpolated anchors, per-point lookup, unmodeled posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.operators.neighbors import damped_weights, knn, nearest

NINE = [(i, j) for i in range(3) for j in range(3)]


def build(values: list[Column]) -> Column:
    return F.array(*[F.array(*values[3 * i : 3 * i + 3]) for i in range(3)])


def blended(points: DataFrame, anchors: DataFrame, k: int, damping: float) -> DataFrame:
    """(id, cov): each point's k nearest anchors' covariances, weighed by exp(-distance / damping)."""
    near = damped_weights(knn(points, anchors.withColumnRenamed("i", "id"), k), damping)
    both = near.join(anchors.select(F.col("i").alias("aid"), "cov"), "aid")
    sums = [F.sum(F.col("w") * F.col("cov")[i][j]).alias(f"s{i}{j}") for i, j in NINE]
    return both.groupBy(F.col("qid").alias("id")).agg(*sums).select("id", build([F.col(f"s{i}{j}") for i, j in NINE]).alias("cov"))


def looked_up(points: DataFrame, table: DataFrame) -> DataFrame:
    """(id, cov) by each point's index ppe_idx in the lookup table."""
    return points.select("id", F.col("ppe_idx").alias("i")).join(table.select("i", "cov"), "i").select("id", "cov")


def unmodeled(points: DataFrame, posts: DataFrame, record: int = 0) -> DataFrame:
    """(id, cov) of the nearest post of a record."""
    own = posts.where(F.col("record") == record)
    near = nearest(points, own.select(F.col("i").alias("id"), "x", "y", "z"))
    return near.join(own.select(F.col("i").alias("aid"), "cov"), "aid").select(F.col("qid").alias("id"), "cov")


def total(points: DataFrame, *parts: DataFrame) -> DataFrame:
    """(id, cov): sums of the chosen parts; a part without a point counts as zeros."""
    out = points.select("id")
    for k, p in enumerate(parts):
        out = out.join(p.select("id", F.col("cov").alias(f"c{k}")), "id", "left")
    at = lambda i, j: sum((F.coalesce(F.col(f"c{k}")[i][j], F.lit(0.0)) for k in range(len(parts))), F.lit(0.0))
    return out.select("id", build([at(i, j) for i, j in NINE]).alias("cov"))


def with_distance(cov: Column, dx: Column, dy: Column, dz: Column) -> Column:
    """A covariance plus the outer product of an offset."""
    d = (dx, dy, dz)
    return build([cov[i][j] + d[i] * d[j] for i, j in NINE])
