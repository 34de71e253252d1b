"""Height classes, masks, tiles, run lengths, scores, registration, watershed over pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.operators.raster import CELL, labels4
from geostrata.session import materialize

#: Class codes of the label raster.
GROUND, BUILDING, ROAD, ELEVATED_ROAD, IGNORED = 2, 6, 11, 17, 65


def height_class(r: DataFrame, candidate: float = 2, seed: float = 4) -> DataFrame:
    return r.withColumn("cls", F.when(F.col("h") > seed, "seed").when(F.col("h") > candidate, "candidate").otherwise("ground"))


def masks(height: DataFrame, index: DataFrame, candidate: tuple[float, float] = (2, 0.2), seed: tuple[float, float] = (4, 0.1)) -> DataFrame:
    """candidate and seed masks: high enough and no vegetation; a cell without an index counts as bare."""
    both = height.join(index, CELL, "left")
    mask = lambda t: (F.col("h") > t[0]) & ~F.coalesce(F.col("g") > t[1], F.lit(False))
    return both.select(*CELL, mask(candidate).alias("candidate"), mask(seed).alias("seed"))


def compose_classes(building, road, bridge):
    """Class code from boolean columns; later ones override."""
    return F.when(bridge, ELEVATED_ROAD).when(road, ROAD).when(building, BUILDING).otherwise(GROUND)


def tiles(r: DataFrame, size: int) -> DataFrame:
    return r.withColumn("tr", F.floor(F.col("row") / size)).withColumn("tc", F.floor(F.col("col") / size))


def tile_windows(spark: SparkSession, rows: int, cols: int, size: int) -> DataFrame:
    """Windows of a raster in tiles, ragged at the far edges."""
    a = spark.range(0, rows, size).select(F.col("id").alias("r0"))
    b = spark.range(0, cols, size).select(F.col("id").alias("c0"))
    return a.crossJoin(F.broadcast(b)).select("r0", "c0", F.least(F.col("r0") + size, F.lit(rows)).alias("r1"), F.least(F.col("c0") + size, F.lit(cols)).alias("c1"))


def double_threshold(probability: DataFrame, low: float, more: float = 0.4, seed: int = 6, other: int = 2) -> DataFrame:
    """(row, col, class) of cells (row, col, p) from low up: seed from low + more up, else the other class."""
    mask = probability.where(F.col("p") >= low)
    return mask.select("row", "col", F.when(F.col("p") >= F.lit(round(low + more, 12)), seed).otherwise(other).alias("class"))


def rle_encode(seq: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(start, length, value) of runs in (i, v); i may have gaps.

    Runs form in blocks of positions (a window each), then runs that meet at block edges join: the
    second window runs over runs, in which long uniform stretches have shrunk to a row a block.
    """
    w = Window.partitionBy(F.floor(F.col("i") / block)).orderBy("i")
    new = F.when((F.col("v") == F.lag("v").over(w)) & (F.col("i") == F.lag("i").over(w) + 1), 0).otherwise(1)
    part = seq.withColumn("b", F.floor(F.col("i") / block)).withColumn("new", new).withColumn("run", F.sum("new").over(w))
    runs = part.groupBy("b", "run", F.col("v").alias("value")).agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("length"))
    # only the first and last run of a block can go on in another
    edge = Window.partitionBy("b")
    runs = runs.withColumn("inner", (F.col("run") > F.min("run").over(edge)) & (F.col("run") < F.max("run").over(edge)))
    inner, outer = runs.where("inner").select("start", "length", "value"), runs.where(~F.col("inner"))
    o = Window.orderBy("start")
    meets = F.when((F.col("value") == F.lag("value").over(o)) & (F.col("start") == (F.lag("start").over(o) + F.lag("length").over(o))), 0).otherwise(1)
    joined = outer.withColumn("new", meets).withColumn("g", F.sum("new").over(o)).groupBy("g", "value").agg(F.min("start").alias("start"), F.sum("length").alias("length"))
    return inner.unionByName(joined.select("start", "length", "value"))


def rle_decode(runs: DataFrame) -> DataFrame:
    at = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))
    return runs.select(at.alias("i"), F.col("value").alias("v"))


def shift_scores(edge: DataFrame, check: DataFrame, reach: int) -> DataFrame:
    """For every shift within reach how many edge points fall on check points: one join and one aggregation."""
    spark = edge.sparkSession
    steps = spark.range(-reach, reach + 1)
    shifts = steps.select(F.col("id").alias("dr")).crossJoin(steps.select(F.col("id").alias("dc")))
    moved = edge.crossJoin(F.broadcast(shifts)).select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "dr", "dc")
    hits = moved.join(check, CELL).groupBy("dr", "dc").agg(F.count(F.lit(1)).alias("score"))
    return shifts.join(hits, ["dr", "dc"], "left").select("dr", "dc", F.coalesce("score", F.lit(0)).alias("score"))


def climb(scores: dict[tuple[int, int], int], most: int) -> tuple[int, int]:
    """Hill climb from no shift over a table of scores: the best neighbour within 45 degrees of the last move, while it gains."""
    at, last = (0, 0), None
    ring = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    for _ in range(most):
        moves = [m for k, m in enumerate(ring) if last is None or min((k - last) % 8, (last - k) % 8) <= 1]
        best = max(moves, key=lambda m: scores.get((at[0] + m[0], at[1] + m[1]), -1))
        if scores.get((at[0] + best[0], at[1] + best[1]), -1) <= scores.get(at, 0):
            break
        at, last = (at[0] + best[0], at[1] + best[1]), ring.index(best)
    return at


def scores(g: DataFrame) -> DataFrame:
    """Overlap and confusion measures of 0/1 columns p (predicted) and t (true)."""
    p, t = F.col("p"), F.col("t")
    s = g.agg(F.sum(p * t).alias("tp"), F.sum(p * (1 - t)).alias("fp"), F.sum((1 - p) * t).alias("fn"), F.sum((1 - p) * (1 - t)).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    r = lambda c: F.round(c, 9)
    return s.select(
        r(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("dice"), r(F.least(F.lit(1.0), 2 * (tp + 1) / (2 * tp + fp + fn + 1))).alias("dice_smooth"), "tp", "fp", "fn", "tn",
        r(F.try_divide(tp, tp + fp)).alias("precision"), r(F.try_divide(tp, tp + fn)).alias("recall"), r(F.try_divide(tp, tp + fp + fn)).alias("iou"),
    )


def grid_triangles(cells: DataFrame, stride: int) -> DataFrame:
    """Two triangles a cell (id of its first corner), corners numbered row by row."""
    c = F.col("id")
    tri = F.explode(F.array(F.struct((c * 2).alias("fid"), c.alias("a"), (c + 1).alias("b"), (c + stride).alias("c")), F.struct((c * 2 + 1).alias("fid"), (c + 1).alias("a"), (c + stride + 1).alias("b"), (c + stride).alias("c"))))
    return cells.select(tri.alias("t")).select("t.*")


def watershed(r: DataFrame, cols: int, rounds: int = 1000) -> DataFrame:
    """(row, col, label) of mask cells flooded step by step from marker components; label 0 where two floods meet at once. Raises where rounds don't suffice."""
    seeds = labels4(r.where("marker and mask"), cols)
    state = materialize(seeds.select(*CELL, (F.col("label") + 1).alias("label")), "watershed")
    mask = r.where("mask").select(*CELL)
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    front = state
    for _ in range(rounds):
        out = front.where("label > 0").withColumn("o", step).select((F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"), "label")
        new = out.join(mask, CELL, "left_semi").join(state, CELL, "left_anti").groupBy(*CELL).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        front = materialize(new.select(*CELL, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(0).alias("label")), "watershed")
        if not front.limit(1).count():
            return state
        state = materialize(state.unionByName(front), "watershed")
    raise RuntimeError(f"floods did not meet in {rounds} rounds")
