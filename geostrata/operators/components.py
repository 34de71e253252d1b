"""Connected components of an edge table, without any collected group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.session import discard, materialize

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id of an edge; component is the least id reachable.

    Each round takes the least label among neighbours, then follows labels once (pointer jumping), so
    chains close in a number of rounds that grows with the logarithm of their length. Least labels are
    pre-aggregated before the shuffle, so a hub costs no more than its edges. Edges whose ends have
    reached the same settled label stay in: they are few against the data they came from.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = materialize(both.union(both.select("v", "u")).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("component")), "cc-labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("m"))
        spread = labels.join(near, "id").select("id", "component", F.least("component", "m").alias("c"))
        spread = materialize(spread, "cc-spread")
        jump = spread.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        new = materialize(spread.join(jump, "c").select("id", F.least("c", "cc").alias("component"), (F.least("c", "cc") != F.col("component")).alias("moved")), "cc-labels")
        moved = new.where("moved").limit(1).count()
        discard(spread)
        discard(labels)
        labels = new.drop("moved")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
