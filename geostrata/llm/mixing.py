"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source has a size (the words of its documents) and a weight; a budget of words is shared by
weight. A source gives at most ``max_epochs`` times its size; what it can't give is shared again by
weight among the others, until no share is above its cap. The fixed point of that resharing is a
water level: target = min(cap, level * weight). Sorted by cap / weight, the sources that are full come
first, so the level follows from running sums over one row per source.

A target of r epochs takes floor(r) whole repetitions of every document and one more of a seeded
sample of them. The sample is those documents whose seeded hash lies under a cut. The cut is found
from sums of words by hash bucket: 4096 buckets a source, then 4096 buckets inside the one where the
wanted words run out. So no task ever holds the documents of a source, and a hot source costs what its
rows cost. Documents in the last bucket that fits only in part are taken in part.

Nulls: a null text has size 0; a null source is a source of its own, after all others; a null id is an empty one in
the hash. Documents with size 0 take 0 words. Repeated rows each count: the hash is of id and text, so rows of one id, or
without one, are sampled apart from each other; rows equal in both are taken alike, in part to within a word each. Very
long texts are counted whole. An empty table gives an empty result. Columns of the input beyond the id, text
and source aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Beyond so many sources their plan isn't broadcast; the joins then shuffle, and Spark splits hot sources.
MAX_BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """How many runs of characters other than ASCII white space the text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Give the sources, by code point with null last, the weights in turn."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (n % len(weights) + 1).cast("int"))
    return sources.withColumn("weight", w)


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Add target to (source, source_size, weight): one row a source, so a single small window.

    budget: as a share of all sizes. Sources without words get 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy(F.try_divide(F.col("cap"), F.col("weight")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        sources.withColumn("source_size", F.col("source_size").cast("double")).withColumn("cap", cap)
        .withColumn("budget", F.least(F.sum("source_size").over(everything) * F.lit(float(budget)), F.sum("cap").over(everything)))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.try_divide(F.col("budget") - F.col("full"), F.col("open")))
    )
    # the first source that its level does not fill sets the level for all; later rows have lower ones
    level = level.withColumn("water", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return level.withColumn("target", target).select("source", "source_key", F.col("source_size").cast("long").alias("source_size"), "weight", "target")


def seeded_digest(doc_id: Column, text: Column, seed: int) -> Column:
    """A digest of id and text: rows without an id, or of one id, fall into different buckets by their texts."""
    none = F.lit("")
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), none), F.lit(":"), F.coalesce(text, none)).cast("binary"))


def hash_bucket(digest: Column, level: int) -> Column:
    """Bucket 0..4095 of a document at a level, from three hex digits of its digest."""
    return F.conv(F.substring(digest, 1 + 3 * level, 3), 16, 10).cast("int")


def cut(sums: DataFrame, keys: list[str], wanted: str) -> DataFrame:
    """For each source the first bucket whose running sum passes the wanted words, and what is left for it.

    sums: (source, bucket, words, wanted), at most 4096 rows a source.
    """
    run = Window.partitionBy(*keys).orderBy("bucket")
    upto = F.sum("words").over(run)
    return (
        sums.withColumn("upto", upto)
        .where(F.col("upto") > F.col(wanted))
        .groupBy(*keys)
        .agg(F.min(F.struct("bucket", (F.col(wanted) - (F.col("upto") - F.col("words"))).alias("left"))).alias("m"))
        .select(*keys, F.col("m.bucket").alias("cut"), F.col("m.left").alias("left"))
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    budget: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Return doc_id, source, size, source_size, target, taken for each document."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), seeded_digest(F.col(doc_id), F.col(text), seed).alias("digest"))
    sized = sized.withColumns({"b1": hash_bucket(F.col("digest"), 0), "b2": hash_bucket(F.col("digest"), 1), "source_key": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))}).drop("digest")
    # the only pass over the texts: all that follows reads these few numbers
    sized = materialize(sized, "mix-sizes")
    by_b1 = sized.groupBy("source", "source_key", "b1").agg(F.sum("size").alias("words"))
    sources = by_b1.groupBy("source", "source_key").agg(F.sum("words").alias("source_size"))
    plan = water_fill(cycle_weights(sources, weights), budget, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.try_divide(F.col("target"), F.col("source_size"))).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(epochs)).withColumn("wanted", F.col("target") - F.floor(epochs) * F.col("source_size"))
    plan = materialize(plan, "mix-plan")
    small = F.broadcast if plan.count() <= MAX_BROADCAST_SOURCES else lambda df: df
    first = cut(by_b1.join(small(plan.select("source_key", "wanted")), "source_key").withColumnRenamed("b1", "bucket"), ["source_key"], "wanted")
    first = first.select("source_key", F.col("cut").alias("cut1"), F.col("left").alias("left1"))
    plan = materialize(plan.drop("source").join(first, "source_key", "left"), "mix-cut")
    inner = sized.join(small(plan.select("source_key", "cut1", "left1")), "source_key").where(F.col("b1") == F.col("cut1"))
    by_b2 = inner.groupBy("source_key", F.col("b2").alias("bucket"), "left1").agg(F.sum("size").alias("words"))
    second = cut(by_b2, ["source_key", "left1"], "left1").select("source_key", F.col("cut").alias("bucket"), F.col("left").alias("left2"))
    last = by_b2.join(second, ["source_key", "bucket"]).select("source_key", F.col("bucket").alias("cut2"), "left2", F.col("words").alias("last_words"))
    plan = plan.join(last, "source_key", "left")
    extra = (
        F.when(F.col("cut1").isNull(), F.when(F.col("wanted") > 0, F.col("size")).otherwise(0))
        .when(F.col("b1") < F.col("cut1"), F.col("size"))
        .when(F.col("b1") > F.col("cut1"), 0)
        .when(F.col("b2") < F.col("cut2"), F.col("size"))
        .when(F.col("b2") > F.col("cut2"), 0)
        .otherwise(F.floor(F.try_divide(F.col("size") * F.col("left2"), F.col("last_words"))))
    )
    out = sized.join(small(plan), "source_key")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("whole") + extra).cast("long").alias("taken"))


def mix_sql(documents: str = "documents", weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 17, columns: str = "doc_id, size, source_size, target, taken") -> str:
    """The same rows in DuckDB SQL."""
    ws = ", ".join(f"{w}::DOUBLE" for w in weights)
    bucket = lambda k: f"('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), {1 + 3 * k}, 3))::INTEGER"
    return f"""
    WITH sized AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             {bucket(0)} AS b1, {bucket(1)} AS b2
      FROM {documents}),
    src AS (SELECT source, sum(size)::DOUBLE AS source_size FROM sized GROUP BY source),
    w AS (SELECT *, list_extract([{ws}], ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} + 1)::INTEGER) AS weight FROM src),
    c AS (SELECT *, source_size * {max_epochs} AS cap FROM w),
    l0 AS (SELECT *, least(sum(source_size) OVER () * {budget}, sum(cap) OVER ()) AS budget,
             coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unfilled
           FROM c WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)),
    l1 AS (SELECT *, (budget - filled) / unfilled AS lvl FROM l0),
    l2 AS (SELECT *, max(CASE WHEN lvl * weight <= cap THEN lvl END) OVER () AS water FROM l1),
    tg AS (SELECT *, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM l2),
    p AS (SELECT source, source_size, target, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole FROM tg),
    p2 AS (SELECT *, target - whole * source_size AS wanted FROM p),
    run AS (SELECT s.doc_id, s.size, s.b1, s.b2, s.source, p2.source_size, p2.target, p2.whole, p2.wanted,
              sum(s.size) OVER (PARTITION BY s.source ORDER BY s.b1, s.b2 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
              sum(s.size) OVER (PARTITION BY s.source, s.b1, s.b2) AS own
            FROM sized s JOIN p2 ON s.source IS NOT DISTINCT FROM p2.source)
    SELECT {columns} FROM (
      SELECT doc_id, source, size, source_size::BIGINT AS source_size, target,
        (size * whole + CASE WHEN upto <= wanted THEN size WHEN upto - own > wanted THEN 0
                             ELSE floor(size * (wanted - (upto - own)) / own) END)::BIGINT AS taken
      FROM run)"""
