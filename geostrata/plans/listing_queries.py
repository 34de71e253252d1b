"""Queries over selections, orders, sets, palettes and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geostrata import fixtures as fx
from geostrata.operators import listing as ls
from geostrata.plans.raster_queries import COLS, GRID, PTS, ROWS, extent, rounded
from geostrata.plans.registry import query
from geostrata.session import table

c = F.col


@query("SELECT vec_id AS id, label FROM embeddings WHERE label IN (1, 3, 5)")
def label_isin(spark, d):
    wanted = spark.createDataFrame([(1,), (3,), (5,)], "label int")
    return ls.in_labels(table(spark, d, "embeddings").select(c("vec_id").alias("id"), "label"), wanted, "label").select("id", "label")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE NOT (starts_with(s_name, 'Supplier#00000000') OR starts_with(s_name, 'Supplier#00000002'))")
def prefix_exclusion(spark, d):
    s = table(spark, d, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"))
    return ls.without_prefixes(s, "name", ["Supplier#00000000", "Supplier#00000002"])


NAMED = "CASE p_partkey % 3 WHEN 0 THEN p_partkey || '_roof.obj' WHEN 1 THEN 'Road' || p_partkey || '.obj' ELSE 'terrain' || p_partkey || '.obj' END"


@query(f"SELECT p_partkey AS id, CASE WHEN regexp_matches({NAMED}, '^[0-9]') THEN 'building' WHEN starts_with({NAMED}, 'Road') THEN 'road' ELSE 'other' END AS kind FROM part")
def model_kinds(spark, d):
    return table(spark, d, "part").select(c("p_partkey").alias("id"), ls.model_kind(F.expr(NAMED)).alias("kind"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE event_id % 11 <> 0 GROUP BY 1")
def nan_drop(spark, d):
    """Every eleventh value is NaN; such rows go."""
    e = table(spark, d, "events").withColumn("value", F.when(c("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(c("value")))
    return e.where(~F.isnan("value")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {PTS} SELECT k1, k2, k3, k4, x, y, z FROM pts WHERE (k1 * 8 + k2) % 50 = 0")
def decimated_points(spark, d):
    """Decimation is the feature: every fiftieth point by its number."""
    return fx.pts(spark, d).where((c("k1") * 8 + c("k2")) % 50 == 0).select("k1", "k2", "k3", "k4", "x", "y", "z")


@query(f"""WITH {GRID} SELECT "row" // 10 AS tr, col // 10 AS tc, count(*) AS n, round(sum(v), 5) AS total FROM grid GROUP BY 1, 2 HAVING avg(v) > 60""")
def alpha_tiles(spark, d):
    """Tiles whose mean reaches a bound."""
    t = fx.grid(spark, d).groupBy(F.floor(c("row") / 10).alias("tr"), F.floor(c("col") / 10).alias("tc")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"))
    return rounded(t.where("mean > 60").drop("mean"), "total", digits=5)


@query("SELECT s_nationkey AS folder, s_name AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY regexp_replace(s_name, '[^0-9]', '', 'g')::BIGINT, s_name) AS place FROM supplier")
def numeric_order(spark, d):
    w = Window.partitionBy("folder").orderBy(ls.trailing_number(c("name")), "name")
    s = table(spark, d, "supplier").select(c("s_nationkey").alias("folder"), c("s_name").alias("name"))
    return s.withColumn("place", F.row_number().over(w).cast("long"))


@query("SELECT DISTINCT substr(o_orderpriority, 3) AS name FROM orders")
def fold_names(spark, d):
    return table(spark, d, "orders").select(F.substr("o_orderpriority", F.lit(3)).alias("name")).distinct()


@query("""SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'first', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def key_sets(spark, d):
    a, b = table(spark, d, "customer").select(c("c_nationkey").alias("k")), table(spark, d, "supplier").select(c("s_nationkey").alias("k"))
    sets = {"both": a.intersect(b), "any": a.union(b).distinct(), "first": a.subtract(b)}
    out = [s.select(F.lit(n).alias("kind"), "k") for n, s in sets.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {PTS}, o AS (SELECT min(x) AS ox, min(y) AS oy, min(z) AS oz FROM pts) SELECT cls, ox, oy, oz, max(x) - ox AS wx, max(y) - oy AS wy, round(max(z) - oz, 6) AS wz FROM pts, o GROUP BY 1, 2, 3, 4")
def mesh_offsets(spark, d):
    """The least offset of all meshes, and each mesh's size from there."""
    p = fx.pts(spark, d)
    o = F.broadcast(p.agg(*[F.min(k).alias(f"o{k}") for k in "xyz"]))  # one row
    w = p.groupBy("cls").agg(*[F.max(k).alias(k) for k in "xyz"]).crossJoin(o)
    return w.select("cls", "ox", "oy", "oz", (c("x") - c("ox")).alias("wx"), (c("y") - c("oy")).alias("wy"), F.round(c("z") - c("oz"), 6).alias("wz"))


@query(f"WITH {PTS}, b AS (SELECT cls, k1, avg(abs(z - red)) AS e, count(*) AS n FROM pts GROUP BY 1, 2) SELECT cls, round(avg(e), 6) AS building_mean, round(sum(e * n) / sum(n), 6) AS area_mean FROM b GROUP BY 1")
def mean_errors(spark, d):
    """Mean error of buildings, each counted once, and weighted by their points."""
    b = fx.pts(spark, d).groupBy("cls", "k1").agg(F.avg(F.abs(c("z") - c("red"))).alias("e"), F.count(F.lit(1)).alias("n"))
    return rounded(b.groupBy("cls").agg(F.avg("e").alias("building_mean"), (F.sum(c("e") * c("n")) / F.sum("n")).alias("area_mean")), "building_mean", "area_mean")


@query("SELECT DISTINCT label FROM embeddings")
def distinct_labels(spark, d):
    return table(spark, d, "embeddings").select("label").distinct()


@query(f"WITH {fx.BANDS_SQL}, s AS (SELECT avg(red) AS mr, stddev_pop(red) AS sr, avg(nir) AS mn, stddev_pop(nir) AS sn FROM bands) SELECT pid, round((red - mr) / sr, 6) AS red, round((nir - mn) / sn, 6) AS nir FROM bands, s")
def bands_standardized(spark, d):
    return rounded(ls.standardized(fx.bands(spark, d).select("pid", "red", "nir"), ["red", "nir"]), "red", "nir")


PALETTE = {0: (0, 0, 0), 1: (255, 0, 0), 2: (0, 255, 0), 3: (0, 0, 255)}


@query("SELECT vec_id AS id, CASE label % 4 WHEN 1 THEN 255 ELSE 0 END AS r, CASE label % 4 WHEN 2 THEN 255 ELSE 0 END AS g, CASE label % 4 WHEN 3 THEN 255 ELSE 0 END AS b FROM embeddings")
def class_palette(spark, d):
    colours = F.create_map(*[x for k, rgb in PALETTE.items() for x in (F.lit(k), F.array(*map(F.lit, rgb)))])
    rgb = F.element_at(colours, (c("label") % 4).cast("int"))
    return table(spark, d, "embeddings").select(c("vec_id").alias("id"), *[rgb[k].alias(n) for k, n in enumerate("rgb")])


@query(f"""WITH {GRID} SELECT "row", col, greatest(CASE WHEN ("row" + col) % 7 = 0 THEN NULL ELSE v END, CASE WHEN col % 5 = 0 THEN NULL ELSE (90 + "row" % 20)::DOUBLE END) AS v FROM grid""")
def surface_composite(spark, d):
    """The higher of two surfaces, each with NaN where it has nothing."""
    nan = F.lit(float("nan"))
    a = F.when((c("row") + c("col")) % 7 == 0, nan).otherwise(c("v"))
    b = F.when(c("col") % 5 == 0, nan).otherwise((90 + c("row") % 20).cast("double"))
    return fx.grid(spark, d).select("row", "col", ls.larger(a, b).alias("v"))


@query(f"""WITH {GRID}, p AS (SELECT s_suppkey AS id, s_acctbal AS x, s_suppkey * 3 - 20 AS y FROM supplier), q AS (SELECT id, least(greatest(trunc((y - 50) / -{fx.DY})::BIGINT, 0), {ROWS} - 1) AS r, least(greatest(trunc((x - 300) / {fx.DX})::BIGINT, 0), {COLS} - 1) AS k FROM p)
SELECT id, r AS "row", k AS col, v FROM q LEFT JOIN grid ON grid."row" = r AND grid.col = k""")
def height_lookup(spark, d):
    """Points in and outside the raster, which begins at (300, 50) and runs south; those outside take the border."""
    p = table(spark, d, "supplier").select(c("s_suppkey").alias("id"), c("s_acctbal").alias("x"), (c("s_suppkey") * 3 - 20).alias("y"))
    return ls.raster_lookup(p, fx.grid(spark, d), *extent(spark, d), fx.DX, -fx.DY, x0=300, y0=50).select("id", "row", "col", "v")


@query(f"""WITH {GRID}, e AS (SELECT {ROWS} AS rn, {COLS} AS cn), t AS (SELECT ("row" - (rn % 16) // 2) // 16 AS tr, (col - (cn % 16) // 2) // 16 AS tc, v FROM grid, e WHERE "row" >= (rn % 16) // 2 AND col >= (cn % 16) // 2 AND ("row" - (rn % 16) // 2) // 16 < rn // 16 AND (col - (cn % 16) // 2) // 16 < cn // 16)
SELECT tr, tc, count(*) AS n, round(max(v), 6) AS top FROM t GROUP BY 1, 2""")
def centred_tiles(spark, d):
    rows, cols = extent(spark, d)
    t = fx.grid(spark, d).withColumns({"tr": ls.centred_tile(c("row"), rows, 16), "tc": ls.centred_tile(c("col"), cols, 16)}).where("tr is not null and tc is not null")
    return t.groupBy("tr", "tc").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("v"), 6).alias("top"))
