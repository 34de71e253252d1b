"""Queries over bands, cameras, images, neighbours, names, tags, rings, sequences and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata import fixtures as fx
from geostrata.fixtures import CAMERA
from geostrata.functions import camera as cam
from geostrata.functions import geometry as geo
from geostrata.functions import spectral as sp
from geostrata.operators import collate, fitting, neighbors, overlay
from geostrata.plans.raster_queries import rounded
from geostrata.plans.registry import query
from geostrata.session import table

B, W, I, V, P = fx.BANDS_SQL, fx.WORLD_SQL, fx.IMGS_SQL, fx.VEC_SQL, fx.PTS_SQL
c = F.col


# bands and radiometry


@query(f"WITH {B} SELECT pid, round(CASE WHEN nir + red <> 0 THEN (nir - red) / (nir + red) END, 9) AS ndvi, round(255 * least(greatest((nir - red) / (nir + red + 1e-7), 0), 1), 6) AS ndvi_byte FROM bands")
def ndvi_pixel(spark, d):
    b = fx.bands(spark, d)
    return b.select("pid", F.round(sp.ndvi(c("nir"), c("red")), 9).alias("ndvi"), F.round(sp.ndvi_byte(c("nir"), c("red")), 6).alias("ndvi_byte"))


@query(f"WITH {B} SELECT pid % 100 AS cell, round(sum((nir - red) / (nir + red)) / 3, 9) AS mean FROM bands GROUP BY 1")
def ndvi_mean(spark, d):
    """Mean over three images: the sum of what each has, over their number."""
    b = fx.bands(spark, d)
    return b.groupBy((c("pid") % 100).alias("cell")).agg(F.round(F.sum(sp.ndvi(c("nir"), c("red"))) / 3, 9).alias("mean"))


@query(f"""WITH {B}, v AS (SELECT pid, 0.5268 * pow(red, -0.1294) * pow(green, 0.3389) * pow(blue, -0.3118) AS v FROM bands WHERE red > 0 AND green > 0 AND blue > 0), s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM v),
z AS (SELECT pid, v, least(greatest((v - m) / s, -4.0), 4.0) AS z FROM v, s) SELECT pid, round(v, 6) AS v, round(z, 6) AS z, round(-1 + (z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) * 2, 6) AS scaled FROM z""")
def vndvi_normalized(spark, d):
    v = fx.bands(spark, d).select("pid", sp.vndvi(c("red"), c("green"), c("blue")).alias("v")).where("v is not null")
    z = v.crossJoin(F.broadcast(v.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")))).select("pid", "v", sp.z_clip(c("v"), c("m"), c("s")).alias("z"))
    out = z.crossJoin(F.broadcast(z.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))))
    return rounded(out.select("pid", "v", "z", sp.rescale(c("z"), c("lo"), c("hi"), (-1, 1)).alias("scaled")), "v", "z", "scaled")


@query(f"""WITH {P}, q AS (SELECT quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.999) AS hi FROM pts)
SELECT k1, k2, k3, k4, floor(1.0 + least(greatest((z - lo) / (hi - lo), 0), 1) * 254)::INTEGER AS byte1, floor(least(greatest((z - lo) / (hi - lo), 0), 1) * 255)::INTEGER AS byte0 FROM pts, q""")
def byte_stretch(spark, d):
    p = fx.pts(spark, d)
    q = p.agg(F.expr("percentile(z, 0.02)").alias("lo"), F.expr("percentile(z, 0.999)").alias("hi"))
    return p.crossJoin(F.broadcast(q)).select("k1", "k2", "k3", "k4", sp.byte_stretch(c("z"), c("lo"), c("hi")).alias("byte1"), sp.byte_stretch(c("z"), c("lo"), c("hi"), 0).alias("byte0"))


@query(f"WITH {P}, m AS (SELECT min(z) AS lo, max(z) AS hi FROM pts) SELECT cls, sum(floor((z - lo) / (hi - lo) * 255))::BIGINT AS q, sum(floor(32768 + (z - lo) / (hi - lo) * 32767))::BIGINT AS colour FROM pts, m GROUP BY 1")
def quantize_minmax(spark, d):
    p = fx.pts(spark, d)
    x = (c("z") - c("lo")) / (c("hi") - c("lo"))
    return p.crossJoin(F.broadcast(p.agg(F.min("z").alias("lo"), F.max("z").alias("hi")))).groupBy("cls").agg(F.sum(F.floor(x * 255)).alias("q"), F.sum(F.floor(32768 + x * 32767)).alias("colour"))


@query("SELECT event_type, round(quantile_cont(value, 0.02), 6) AS p02, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.98), 6) AS p98 FROM events WHERE NOT isnan(value) GROUP BY 1")
def property_percentiles(spark, d):
    e = table(spark, d, "events").where(~F.isnan("value")).groupBy("event_type")
    return e.agg(*[F.round(F.expr(f"percentile(value, {p})"), 6).alias(n) for n, p in (("p02", 0.02), ("p50", 0.5), ("p98", 0.98))])


@query("SELECT event_id, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_range(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.min("value").over(w).alias("lo"), F.max("value").over(w).alias("hi"))


@query("WITH b AS (SELECT min(value) lo, max(value) hi FROM events) SELECT least(floor((value - lo) / ((hi - lo) / 50)), 49)::BIGINT AS bin, count(*) AS n FROM events, b GROUP BY 1")
def error_histogram50(spark, d):
    return collate.histogram(table(spark, d, "events"), "value", 50)


@query("""SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance,
round(avg((value - m) ** 3) / pow(avg((value - m) ** 2), 1.5), 6) AS skew, round(avg((value - m) ** 4) / pow(avg((value - m) ** 2), 2) - 3, 6) AS kurt FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1""")
def describe_stats(spark, d):
    a = {"n": F.count(F.lit(1)), "lo": F.min("value"), "hi": F.max("value"), "mean": F.round(F.avg("value"), 6), "variance": F.round(F.var_samp("value"), 4), "skew": F.round(F.skewness("value"), 6), "kurt": F.round(F.kurtosis("value"), 6)}
    return table(spark, d, "events").groupBy("event_type").agg(*[v.alias(k) for k, v in a.items()])


PROBS = "pr AS (SELECT vec_id % 60 AS pixel, dim % 12 AS class, sum(exp(embedding[dim + 1]::DOUBLE)) AS p FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS dim FROM embeddings) GROUP BY 1, 2)"


@query(f"WITH {PROBS} SELECT pixel, class AS best, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY p DESC, class) AS r FROM pr WHERE class >= 1) WHERE r = 1")
def material_argmax(spark, d):
    """Sums of class probabilities over images; the best class but 0, the lowest among equals."""
    e = table(spark, d, "embeddings").select((c("vec_id") % 60).alias("pixel"), F.posexplode("embedding").alias("dim", "v"))
    s = e.groupBy("pixel", (c("dim") % 12).cast("long").alias("class")).agg(F.sum(F.exp(c("v").cast("double"))).alias("p")).where("class >= 1")
    return s.groupBy("pixel").agg(F.max(F.struct("p", (-c("class")).alias("low"))).alias("m")).select("pixel", (-c("m.low")).alias("best"), F.round("m.p", 6).alias("p"))


@query("SELECT l_suppkey AS poly, l_linenumber AS label, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) AS r FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE r = 1")
def label_mode(spark, d):
    n = table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("poly"), c("l_linenumber").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("poly").agg(F.max(F.struct("n", (-c("label")).alias("low"))).alias("m")).select("poly", (-c("m.low")).alias("label"), "m.n")


JD = """(floor(365.25::DOUBLE * ((CASE WHEN m <= 2 THEN y - 1 ELSE y END) + 4716)) + floor(30.6001::DOUBLE * ((CASE WHEN m <= 2 THEN m + 12 ELSE m END) + 1)) + day(ts) + (hour(ts) + (minute(ts) + floor(second(ts)) / 60.0) / 60.0) / 24.0
 + (2 - floor((CASE WHEN m <= 2 THEN y - 1 ELSE y END) / 100) + floor(floor((CASE WHEN m <= 2 THEN y - 1 ELSE y END) / 100) / 4)) - 1524.5::DOUBLE)"""
CAL = f"cal AS (SELECT event_id, value, {JD} AS jd, 357.529::DOUBLE + 0.98560028::DOUBLE * ({JD} - 2451545.0::DOUBLE) AS g FROM (SELECT *, year(ts) AS y, month(ts) AS m FROM events))"


@query(f"WITH {CAL} SELECT event_id, round(jd, 5) AS jd, round(1.00014::DOUBLE - 0.01671::DOUBLE * cos(radians(g)) - 0.00014::DOUBLE * cos(2 * radians(g)), 9) AS dist FROM cal")
def earth_sun_distance(spark, d):
    jd = sp.julian_date(c("ts"))
    return table(spark, d, "events").select("event_id", F.round(jd, 5).alias("jd"), F.round(sp.earth_sun_distance(jd), 9).alias("dist"))


@query(f"""WITH {CAL}, r AS (SELECT event_id, 0.95::DOUBLE * value * (0.01::DOUBLE + (event_id % 8) * 0.001::DOUBLE) / 0.05::DOUBLE - 0.3::DOUBLE AS l, 1.00014::DOUBLE - 0.01671::DOUBLE * cos(radians(g)) - 0.00014::DOUBLE * cos(2 * radians(g)) AS dist FROM cal)
SELECT event_id, round(l, 6) AS radiance, round(l * dist * dist * pi() / ((1500 + (event_id % 8) * 50) * cos(radians(90.0::DOUBLE - 52.5))), 6) AS reflectance FROM r""")
def toa_reflectance(spark, d):
    band = c("event_id") % 8
    light = sp.radiance(c("value"), F.lit(0.95), F.lit(-0.3), F.lit(0.01) + band * F.lit(0.001), F.lit(0.05))
    r = sp.reflectance(light, sp.earth_sun_distance(sp.julian_date(c("ts"))), 1500 + band * 50, F.lit(52.5))
    return table(spark, d, "events").select("event_id", F.round(light, 6).alias("radiance"), F.round(r, 6).alias("reflectance"))


# positions and cameras


@query(f"""WITH {W}, q AS (SELECT pid, lon * 3 + 180 AS lon, lat * -2 AS lat FROM world) SELECT pid, CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 42
THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END ELSE floor((floor(lon) + 180) / 6) + 1 END::INTEGER AS zone, CASE WHEN lat > 0 THEN 'N' ELSE 'S' END AS hemi FROM q""")
def utm_zone(spark, d):
    w = fx.world(spark, d).select("pid", (c("lon") * 3 + 180).alias("lon"), (c("lat") * -2).alias("lat"))
    return w.select("pid", geo.utm_zone(c("lon"), c("lat")).alias("zone"), geo.hemisphere(c("lat")).alias("hemi"))


@query(f"WITH {P} SELECT k1, k2, k3, k4, 500000 + x * 0.25 + 0.125 AS wx, 4000000 - y * 0.25 AS wy, floor((500000 + x * 0.25 + 0.125 - 500000) / 0.25)::BIGINT AS px, floor((4000000 - y * 0.25 - 4000000) / -0.25)::BIGINT AS py FROM pts")
def geotransform_fwd_inv(spark, d):
    gt = (500000.0, 0.25, 0.0, 4000000.0, 0.0, -0.25)
    wx, wy = geo.geo_forward(gt, c("x") + 0.5, c("y"))
    p = fx.pts(spark, d).select("k1", "k2", "k3", "k4", wx.alias("wx"), wy.alias("wy"))
    px, py = geo.geo_inverse(gt, c("wx"), c("wy"))
    return p.select("*", px.alias("px"), py.alias("py"))


U, VV = cam.project_sql(CAMERA, "lon", "lat", "alt")


@query(f"WITH {W} SELECT pid, round({U}, 5) AS u, round({VV}, 5) AS v FROM world")
def rpc_project(spark, d):
    u, v = cam.project(CAMERA, c("lon"), c("lat"), c("alt"))
    return fx.world(spark, d).select("pid", F.round(u, 5).alias("u"), F.round(v, 5).alias("v"))


OCC = f"pr AS (SELECT pid, alt, floor(({U}) / 400)::BIGINT AS px, floor(({VV}) / 400)::BIGINT AS py FROM world)"


@query(f"WITH {W}, {OCC}, o AS (SELECT *, max(alt) OVER (PARTITION BY px, py) AS top FROM pr WHERE px BETWEEN 0 AND 105 AND py BETWEEN 0 AND 106) SELECT pid, px, py FROM o WHERE top <= alt + 1.0")
def rpc_occlusion(spark, d):
    """Points that the camera sees: in the image, and not under a higher point of the same pixel."""
    u, v = cam.project(CAMERA, c("lon"), c("lat"), c("alt"))
    p = fx.world(spark, d).select("pid", "alt", F.floor(u / 400).alias("px"), F.floor(v / 400).alias("py")).where("px between 0 and 105 and py between 0 and 106")
    return p.withColumn("top", F.max("alt").over(Window.partitionBy("px", "py"))).where("top <= alt + 1.0").select("pid", "px", "py")


@query(f"WITH {W}, {OCC} SELECT px, py, max(alt) AS z, count(*) AS n FROM pr GROUP BY 1, 2")
def painters_height(spark, d):
    """The height that a painter's pass in order of height would leave: the largest."""
    u, v = cam.project(CAMERA, c("lon"), c("lat"), c("alt"))
    p = fx.world(spark, d).select("alt", F.floor(u / 400).alias("px"), F.floor(v / 400).alias("py"))
    return p.groupBy("px", "py").agg(F.max("alt").alias("z"), F.count(F.lit(1)).alias("n"))


@query()
def rpc_backproject_roundtrip(spark, d):
    return fitting.back_projected(fx.world(spark, d), CAMERA)


UC, VC = cam.project_sql(CAMERA.cropped(1000, 2000), "lon", "lat", "alt")


@query(f"WITH {W}, b AS (SELECT min(lon) l, max(lon) r, min(lat) b, max(lat) t, min(alt) lo, max(alt) hi FROM world), e AS (SELECT lon, lat, alt FROM b, LATERAL (SELECT unnest([l, r]) AS lon) a1, LATERAL (SELECT unnest([b, t]) AS lat) a2, LATERAL (SELECT unnest([lo, hi]) AS alt) a3) SELECT round(min({UC}), 4) AS u0, round(max({UC}), 4) AS u1, round(min({VC}), 4) AS v0, round(max({VC}), 4) AS v1 FROM e")
def aoi_window(spark, d):
    """Window of a cropped image that an area's corners at its lowest and highest altitude span."""
    w = fx.world(spark, d).agg(*[F.array(F.min(n), F.max(n)).alias(n) for n in ("lon", "lat", "alt")])
    for n in ("lon", "lat", "alt"):
        w = w.withColumn(n, F.explode(n))
    u, v = cam.project(CAMERA.cropped(1000, 2000), c("lon"), c("lat"), c("alt"))
    return w.agg(*[F.round(f(x), 4).alias(n) for n, f, x in (("u0", F.min, u), ("u1", F.max, u), ("v0", F.min, v), ("v1", F.max, v))])


# images and names


@query(f"WITH {I} SELECT path, row_number() OVER (ORDER BY 144 - greatest(0, least(maxx, 30) - greatest(minx, 18)) * greatest(0, least(maxy, 32) - greatest(miny, 20)), cloud, angle, path) AS rank FROM imgs")
def image_rank(spark, d):
    i = fx.imgs(spark, d)
    left = 144 - geo.box_overlap((c("minx"), c("miny"), c("maxx"), c("maxy")), (F.lit(18.0), F.lit(20.0), F.lit(30.0), F.lit(32.0)))
    return collate.ranked(i.withColumn("left", left), ["left", "cloud", "angle", "path"]).select("path", "rank")


DSMS = "dsms AS (SELECT n_nationkey AS dsm, (n_nationkey % 5)::DOUBLE * 9 AS ax, floor(n_nationkey / 5) * 9 AS ay FROM nation)"


@query(f"""WITH {I}, {DSMS}, o AS (SELECT dsm, path, cloud, angle, greatest(0, least(maxx, ax + 11) - greatest(minx, ax)) * greatest(0, least(maxy, ay + 11) - greatest(miny, ay)) AS area FROM imgs, dsms)
SELECT dsm, path, area FROM (SELECT *, row_number() OVER (PARTITION BY dsm ORDER BY area DESC, cloud, angle, path) AS r FROM o WHERE area > 0) WHERE r = 1""")
def best_image_per_dsm(spark, d):
    n = c("n_nationkey")
    dsms = table(spark, d, "nation").select(n.alias("dsm"), ((n % 5).cast("double") * 9).alias("ax"), (F.floor(n / 5) * 9).cast("double").alias("ay"))
    return collate.best_image(fx.imgs(spark, d), dsms)


@query("""WITH n AS (SELECT lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') || (['JAN','FEB','SEP'])[(s_suppkey % 3 + 1)::INTEGER] || '15WV0' || lpad(s_suppkey::VARCHAR, 5, '0') AS pre, s_suppkey, (['P1BS','M1BS','A1BS'])[(s_suppkey % 3 + 1)::INTEGER] AS m, (s_suppkey // 3)::VARCHAR AS o FROM supplier),
f AS (SELECT upper(pre || '-' || m || '-' || lpad(o, 12, '0') || '_01_p001_x.ntf') AS name FROM n) SELECT name, regexp_extract(name, '^(.*)-(P1BS|M1BS|A1BS)-([0-9]+_[0-9]+_P[0-9]+)(.*)\\.([A-Z]+)$', 1) AS prefix, regexp_extract(name, '^(.*)-(P1BS|M1BS|A1BS)-([0-9]+_[0-9]+_P[0-9]+)(.*)\\.([A-Z]+)$', 2) AS modality,
regexp_extract(name, '^(.*)-(P1BS|M1BS|A1BS)-([0-9]+_[0-9]+_P[0-9]+)(.*)\\.([A-Z]+)$', 3) AS trail, regexp_extract(name, '^(.*)-(P1BS|M1BS|A1BS)-([0-9]+_[0-9]+_P[0-9]+)(.*)\\.([A-Z]+)$', 5) AS ext FROM f""")
def collate_files(spark, d):
    return collate.parse_names(image_names(spark, d))


def image_names(spark, d) -> DataFrame:
    k = c("s_suppkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % 3 + 1).cast("int"))
    pre = F.concat(F.lpad((k % 28 + 1).cast("string"), 2, "0"), pick("JAN", "FEB", "SEP"), F.lit("15WV0"), F.lpad(k.cast("string"), 5, "0"))
    name = F.concat(pre, F.lit("-"), pick("P1BS", "M1BS", "A1BS"), F.lit("-"), F.lpad(F.floor(k / 3).cast("string"), 12, "0"), F.lit("_01_p001_x.ntf"))
    return table(spark, d, "supplier").select(F.upper(name).alias("name"))


@query("""WITH k AS (SELECT s_suppkey // 3 AS id, s_suppkey % 3 AS m, s_name FROM supplier WHERE s_suppkey % 7 <> 3) SELECT id::BIGINT AS id, max(s_name) FILTER (m = 0) AS image, max(s_name) FILTER (m = 1) AS rpc, max(s_name) FILTER (m = 2) AS info FROM k GROUP BY 1
HAVING max(s_name) FILTER (m = 0) IS NOT NULL AND max(s_name) FILTER (m = 1) IS NOT NULL""")
def complete_collections(spark, d):
    k = c("s_suppkey")
    rows = table(spark, d, "supplier").where(k % 7 != 3).select(F.floor(k / 3).alias("id"), F.element_at(F.array(F.lit("image"), F.lit("rpc"), F.lit("info")), (k % 3 + 1).cast("int")).alias("part"), c("s_name").alias("file"))
    return collate.collections(rows).where("image is not null and rpc is not null")


@query("SELECT page_id, upper(regexp_extract(url, '([^/]+)$', 1)) AS base, regexp_replace(regexp_extract(url, '([^/]+)$', 1), '\\.[^.]*$', '') AS stem, CASE WHEN regexp_matches(regexp_extract(url, '([^/]+)$', 1), '^[0-9]') THEN 'building' WHEN url LIKE '%/p%' THEN 'road' ELSE 'other' END AS kind, coalesce(CAST(nullif(regexp_replace(url, '[^0-9]', '', 'g'), '') AS HUGEINT) % 1000003, -1)::BIGINT AS suffix FROM pages")
def name_parts(spark, d):
    base = F.regexp_extract("url", "([^/]+)$", 1)
    digits = F.nullif(F.regexp_replace("url", "[^0-9]", ""), F.lit("")).cast("decimal(38,0)")
    kind = F.when(base.rlike("^[0-9]"), "building").when(c("url").contains("/p"), "road").otherwise("other")
    return table(spark, d, "pages").select("page_id", F.upper(base).alias("base"), F.regexp_replace(base, r"\.[^.]*$", "").alias("stem"), kind.alias("kind"), F.coalesce((digits % 1000003).cast("long"), F.lit(-1)).alias("suffix"))


TAGS = """tg AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'residential' WHEN 'click' THEN 'motorway' END AS highway, CASE WHEN user_id % 4 = 0 THEN 'rail' WHEN user_id % 4 = 1 THEN 'tram' END AS railway,
 CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS bridge FROM events), ty AS (SELECT *, CASE WHEN highway IS NOT NULL THEN 'highway' WHEN railway IS NOT NULL THEN 'railway' END AS class, coalesce(highway, railway) AS type FROM tg)"""


def tags(spark, d) -> DataFrame:
    e, t, u = table(spark, d, "events"), c("event_type"), c("user_id")
    highway = F.when(t == "view", "residential").when(t == "click", "motorway")
    rail = F.when(u % 4 == 0, "rail").when(u % 4 == 1, "tram")
    return collate.road_class(e.select("event_id", highway.alias("highway"), rail.alias("railway"), (c("event_id") % 3 == 0).cast("int").alias("bridge")))


@query(f"WITH {TAGS} SELECT event_id, class, type FROM ty WHERE bridge = 1 AND (type = 'monorail' OR (class = 'highway' AND type NOT IN ('footway', 'pedestrian')))")
def elevated_roads(spark, d):
    return tags(spark, d).where("bridge = 1 and (type = 'monorail' or class = 'highway' and type not in ('footway', 'pedestrian'))").select("event_id", "class", "type")


@query(f"WITH {TAGS} SELECT event_id, class, type FROM ty WHERE type NOT IN ('rail')")
def all_roads(spark, d):
    return tags(spark, d).where("type not in ('rail')").select("event_id", "class", "type")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'x' || event_type AS layer FROM events")
def osm_tags(spark, d):
    hstore = F.concat(F.regexp_replace(F.regexp_replace("props", r"^\{|\}$", ""), ":", "=>"), F.lit(',"layer"=>"x'), c("event_type"), F.lit('"'))
    m = collate.hstore(hstore)
    return table(spark, d, "events").select("event_id", F.element_at(m, "k").alias("k"), F.element_at(m, "layer").alias("layer"))


# neighbours and error model

D2 = "(q.x - a.x) * (q.x - a.x) + (q.y - a.y) * (q.y - a.y) + (q.z - a.z) * (q.z - a.z)"
KNN = f"{V}, nn AS (SELECT q.id AS qid, a.id AS aid, {D2} AS d2, row_number() OVER (PARTITION BY q.id ORDER BY {D2}, a.id) AS r FROM vec q, vec a WHERE q.id % 20 = 0)"


def knn8(spark, d, k: int) -> DataFrame:
    v = fx.vec(spark, d)
    return neighbors.knn(v.where("id % 20 = 0"), v, k)


@query(f"""WITH {KNN}, w AS (SELECT *, exp(-sqrt(d2) / 0.5) / sum(exp(-sqrt(d2) / 0.5)) OVER (PARTITION BY qid) AS w FROM nn WHERE r <= 8) SELECT qid, round(sum(w * v.x * v.x), 6) AS cxx, round(sum(w * v.x * v.y), 6) AS cxy, round(sum(w * v.z), 6) AS mz FROM w JOIN vec v ON v.id = aid GROUP BY 1""")
def knn_idw_covariance(spark, d):
    w = neighbors.damped_weights(knn8(spark, d, 8), 0.5).join(fx.vec(spark, d).withColumnRenamed("id", "aid"), "aid")
    return w.groupBy("qid").agg(F.round(F.sum(c("w") * c("x") * c("x")), 6).alias("cxx"), F.round(F.sum(c("w") * c("x") * c("y")), 6).alias("cxy"), F.round(F.sum(c("w") * c("z")), 6).alias("mz"))


@query(f"WITH {KNN} SELECT qid, v.label, round(d2, 9) AS d2 FROM nn JOIN vec v ON v.id = aid WHERE r = 1")
def label_transfer(spark, d):
    return neighbors.nearest(fx.vec(spark, d).where("id % 20 = 0"), fx.vec(spark, d)).join(fx.vec(spark, d).select(c("id").alias("aid"), "label"), "aid").select("qid", "label", F.round("d2", 9).alias("d2"))


@query(f"WITH {KNN} SELECT qid, aid, r AS rank FROM nn WHERE r <= 3")
def three_nn_grid(spark, d):
    v = fx.vec(spark, d)
    return neighbors.knn_grid(v.where("id % 20 = 0"), v, 3).select("qid", "aid", c("rank").cast("long").alias("rank"))


@query(f"WITH {KNN}, w AS (SELECT *, (1 / greatest(d2, 1e-10)) / sum(1 / greatest(d2, 1e-10)) OVER (PARTITION BY qid) AS w FROM nn WHERE r <= 3) SELECT qid, round(sum(w * v.x), 6) AS fx, round(sum(w * v.label), 6) AS fl FROM w JOIN vec v ON v.id = aid GROUP BY 1")
def three_nn_interpolate(spark, d):
    w = neighbors.inverse_weights(knn8(spark, d, 3)).join(fx.vec(spark, d).withColumnRenamed("id", "aid"), "aid")
    return w.groupBy("qid").agg(F.round(F.sum(c("w") * c("x")), 6).alias("fx"), F.round(F.sum(c("w") * c("label")), 6).alias("fl"))


@query(f"""WITH {V}, h AS (SELECT q.id AS qid, a.id AS pid, row_number() OVER (PARTITION BY q.id ORDER BY a.id) AS r FROM vec q, vec a WHERE {D2} < 0.04), l AS (SELECT qid, list(pid ORDER BY pid) AS ids FROM h WHERE r <= 4 GROUP BY 1)
SELECT qid, slot, CASE WHEN slot < len(ids) THEN ids[slot + 1] ELSE ids[1] END AS pid FROM l, range(0, 4) t(slot)""")
def ball_query(spark, d):
    v = fx.vec(spark, d)
    return neighbors.ball_query(v, v, 0.2, 4)


@query(f"WITH {V}, h AS (SELECT q.id AS qid, a.z AS z, {D2} AS d2 FROM vec q, vec a WHERE {D2} < 0.04) SELECT qid, max(z) AS zmax, round(avg(z), 6) AS zavg, round(sum(exp(-5 * sqrt(d2)) * z) / sum(exp(-5 * sqrt(d2))), 6) AS zw, round(pow(avg(pow(abs(z), 3)), 1.0::DOUBLE / 3), 6) AS gem FROM h GROUP BY 1")
def neighbourhood_pooling(spark, d):
    v = fx.vec(spark, d)
    h = neighbors.pooled(v, v, 0.2, "z", 5)
    gem = F.pow(c("cubes") / c("n"), F.lit(1.0 / 3))
    return h.select("qid", c("top").alias("zmax"), F.round(c("total") / c("n"), 6).alias("zavg"), F.round(c("weighted") / c("weight"), 6).alias("zw"), F.round(gem, 6).alias("gem"))


@query(f"""WITH {V}, nn AS (SELECT q.id, {D2} AS d2, row_number() OVER (PARTITION BY q.id ORDER BY {D2}, a.id) AS r FROM vec q, vec a WHERE q.id <> a.id), m AS (SELECT id, avg(sqrt(d2)) AS mean_d FROM nn WHERE r <= 20 GROUP BY 1)
SELECT id, round(mean_d, 6) AS mean_d FROM m WHERE mean_d < (SELECT avg(mean_d) + 2.0 * stddev_pop(mean_d) FROM m)""")
def statistical_outliers(spark, d):
    return rounded(neighbors.inliers(fx.vec(spark, d), 20, 2.0), "mean_d")


@query()
def fps_sample(spark, d):
    return neighbors.farthest_points(fx.vec(spark, d), "label", 10)


@query(f"""WITH RECURSIVE {V}, e AS (SELECT q.id AS a, a.id AS b FROM vec q, vec a WHERE {D2} < 0.0225 AND q.id <> a.id), r AS (SELECT id AS a, id AS b FROM vec UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), l AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY 1)
SELECT id, cluster FROM l WHERE cluster IN (SELECT cluster FROM l GROUP BY 1 HAVING count(*) BETWEEN 3 AND 600000)""")
def euclidean_clusters(spark, d):
    return neighbors.clusters(fx.vec(spark, d), 0.15, 3, 600000)


@query(f"WITH {V}, cu AS (SELECT id, sum(abs(x)) OVER (ORDER BY id) AS cum FROM vec), t AS (SELECT max(cum) AS total FROM cu), q AS (SELECT k, (k + 0.5::DOUBLE) / 40 AS u FROM range(0, 40) s(k)) SELECT k, min(id) AS id FROM q, t, cu WHERE cum >= u * total GROUP BY 1")
def prob_sample(spark, d):
    v = fx.vec(spark, d).select("id", F.abs("x").alias("w"))
    q = spark.range(40).select(c("id").alias("k"), ((c("id") + 0.5) / 40).alias("u"))
    return collate.sample_by_weight(v, q)


# voxels, sequences, histograms


@query(f"WITH {P} SELECT floor(x / 50)::BIGINT AS i, floor(y / 10)::BIGINT AS j, floor(z / 5)::BIGINT AS k, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z FROM pts GROUP BY 1, 2, 3")
def voxel_downsample(spark, d):
    return rounded(collate.voxel_means(fx.pts(spark, d), (50, 10, 5)), "x", "y", "z", digits=9)


@query(f"WITH {P} SELECT cls, count(DISTINCT (floor(x / 50), floor(y / 10), floor(z / 5))) AS voxels, count(DISTINCT (floor(x / 50), floor(y / 10), floor(z / 5))) / 8000.0 >= 0.02 AS dense FROM pts GROUP BY 1")
def voxel_occupancy(spark, d):
    v = fx.pts(spark, d).select("cls", F.floor(c("x") / 50).alias("i"), F.floor(c("y") / 10).alias("j"), F.floor(c("z") / 5).alias("k")).distinct()
    return v.groupBy("cls").agg(F.count(F.lit(1)).alias("voxels")).withColumn("dense", c("voxels") / 8000 >= 0.02)


@query("WITH l AS (SELECT event_id, user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 21600 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM l")
def gap_clusters(spark, d):
    return collate.gap_clusters(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", F.unix_micros(c("ts").cast("timestamp")) / 1e6, ["ts", "event_id"], 21600)


@query("WITH b AS (SELECT floor(value / 10)::BIGINT AS bin, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1), k AS (SELECT bin FROM b WHERE n > 0.1 * (SELECT max(n) FROM b)) SELECT min(bin) AS first, max(bin) AS last, count(*) AS kept FROM k")
def histogram_trim(spark, d):
    """Bins of 10 with more than a tenth of the largest count."""
    b = table(spark, d, "events").where("event_type <> 'error'").groupBy(F.floor(c("value") / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return collate.surviving_bins(b, 0.1).agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.count(F.lit(1)).alias("kept"))


@query("""WITH v AS (SELECT event_type, value FROM events WHERE value IS NOT NULL), r AS (SELECT min(value) AS lo, (max(value) - min(value)) / 50 AS step FROM v), b AS (SELECT least(floor((value - lo) / step), 49)::BIGINT AS bin, count(*) AS n FROM v, r GROUP BY 1)
SELECT min(bin) AS first, max(bin) AS last FROM b WHERE n > 0.2 * (SELECT max(n) FROM b)""")
def histogram_ends(spark, d):
    """Of 50 bins over the range the first and last with more than a fifth of the largest count."""
    b = collate.histogram(table(spark, d, "events").where("value is not null"), "value", 50)
    return collate.surviving_bins(b, 0.2).agg(F.min("bin").alias("first"), F.max("bin").alias("last"))


@query("SELECT c_custkey AS id, (c_custkey % 5)::INTEGER AS fold, (c_custkey // 10)::BIGINT AS tile FROM customer")
def fold_assign(spark, d):
    return table(spark, d, "customer").select(c("c_custkey").alias("id"), (c("c_custkey") % 5).cast("int").alias("fold"), F.floor(c("c_custkey") / 10).alias("tile"))


# rings, meshes, fits

RING = "ring AS (SELECT c_nationkey AS id, list(struct_pack(x := (c_custkey % 97)::DOUBLE, y := c_acctbal / 100) ORDER BY c_custkey) AS r FROM customer GROUP BY 1 HAVING count(*) >= 3)"


def rings(spark, d) -> DataFrame:
    k = table(spark, d, "customer")
    p = F.sort_array(F.collect_list(F.struct("c_custkey", (c("c_custkey") % 97).cast("double").alias("x"), (c("c_acctbal") / 100).alias("y"))))
    r = k.groupBy(c("c_nationkey").alias("id")).agg(p.alias("p")).where(F.size("p") >= 3)
    return r.select("id", F.transform("p", lambda q: F.struct(q.x.alias("x"), q.y.alias("y"))).alias("r"))


def ring_vertices(spark, d) -> DataFrame:
    """(id, k, x, y) of the same rings, a row a vertex."""
    k = table(spark, d, "customer").select(c("c_nationkey").alias("id"), c("c_custkey").alias("k"), (c("c_custkey") % 97).cast("double").alias("x"), (c("c_acctbal") / 100).cast("double").alias("y"))
    many = k.groupBy(c("id").alias("kept")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("kept")
    return k.join(many, c("id").eqNullSafe(c("kept")), "left_semi")


SHOELACE = "list_sum(list_transform(range(1, len(r) + 1), lambda i: r[i].x * r[i % len(r) + 1].y - r[i % len(r) + 1].x * r[i].y)) / 2"


@query(f"WITH {RING} SELECT id, round({SHOELACE}, 6) AS area, {SHOELACE} > 0 AS ccw, len(r)::INTEGER AS n FROM ring")
def ring_area_orientation(spark, d):
    a = geo.signed_area(c("r"))
    return rings(spark, d).select("id", F.round(a, 6).alias("area"), (a > 0).alias("ccw"), F.size("r").alias("n"))


@query(f"""WITH {RING} SELECT id, round((list_min(list_transform(r, lambda p: p.x)) + list_max(list_transform(r, lambda p: p.x))) / 2, 6) AS cx, round((list_min(list_transform(r, lambda p: p.y)) + list_max(list_transform(r, lambda p: p.y))) / 2, 6) AS cy,
id || ' 0 1 ' || len(r) AS region FROM ring""")
def bbox_center_kw18(spark, d):
    x0, y0, x1, y1 = geo.ring_bounds(c("r"))
    return rings(spark, d).select("id", F.round((x0 + x1) / 2, 6).alias("cx"), F.round((y0 + y1) / 2, 6).alias("cy"), F.concat_ws(" ", c("id"), F.lit("0 1"), F.size("r")).alias("region"))


@query(f"""WITH {RING}, q AS (SELECT s_suppkey AS pid, (s_suppkey % 97)::DOUBLE + 0.25 AS x, abs(s_acctbal) / 150 AS y FROM supplier), h AS (SELECT pid, id, list_sum(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN (r[i].y > y) <> (r[i % len(r) + 1].y > y)
 AND x < (r[i % len(r) + 1].x - r[i].x) * (y - r[i].y) / (r[i % len(r) + 1].y - r[i].y) + r[i].x THEN 1 ELSE 0 END)) % 2 = 1 AS inside FROM q, ring) SELECT pid, min(id) AS first_ring, count(*) AS n FROM h WHERE inside GROUP BY 1""")
def point_in_polygon(spark, d):
    q = table(spark, d, "supplier").select(c("s_suppkey").alias("pid"), ((c("s_suppkey") % 97).cast("double") + 0.25).alias("x"), (F.abs("s_acctbal") / 150).alias("y"))
    hit = overlay.containing(q, overlay.edges_of(ring_vertices(spark, d)))
    return hit.groupBy("pid").agg(F.min("id").alias("first_ring"), F.count(F.lit(1)).alias("n"))


@query("WITH f AS (SELECT o_orderpriority AS file, o_custkey % 50 AS v FROM orders), n AS (SELECT file, count(*) AS nv FROM f GROUP BY 1), o AS (SELECT file, nv, coalesce(sum(nv) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM n) SELECT f.file, base, max(v + base)::BIGINT AS top FROM f JOIN o USING (file) GROUP BY 1, 2")
def merge_mesh_rebase(spark, d):
    f = table(spark, d, "orders").select(c("o_orderpriority").alias("file"), (c("o_custkey") % 50).alias("v"))
    base = fitting.vertex_offsets(f.groupBy("file").agg(F.count(F.lit(1)).alias("nv")))
    return f.join(base, "file").groupBy("file", "base").agg(F.max(c("v") + c("base")).alias("top"))


@query(f"WITH {P} SELECT cls, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, round(var_pop(x), 4) AS xx, round(covar_pop(x, y), 4) AS xy, round(covar_pop(x, z), 4) AS xz, round(var_pop(y), 4) AS yy, round(covar_pop(y, z), 4) AS yz, round(var_pop(z), 4) AS zz FROM pts GROUP BY 1")
def plane_fit_moments(spark, d):
    m = fitting.moments(fx.pts(spark, d), "cls")
    return rounded(rounded(m, "cx", "cy", "cz"), "xx", "xy", "xz", "yy", "yz", "zz", digits=4)


@query()
def plane_fit(spark, d):
    return fitting.planes(fx.pts(spark, d), "cls")


POLY = "s AS (SELECT l_linenumber AS g, count(*)::DOUBLE AS n, sum(x) AS s1, sum(x * x) AS s2, sum(x ** 3) AS s3, sum(x ** 4) AS s4, sum(y) AS t0, sum(x * y) AS t1, sum(x * x * y) AS t2 FROM (SELECT l_linenumber, l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem) GROUP BY 1)"
DET = "(n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))"


@query(f"WITH {POLY} SELECT g, round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / {DET}, 6) AS c0, round((n * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / {DET}, 6) AS c1, round((n * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / {DET}, 6) AS c2 FROM s")
def poly2_fit(spark, d):
    p = table(spark, d, "lineitem").select(c("l_linenumber").alias("g"), (c("l_quantity") / 50).alias("x"), (c("l_extendedprice") / 100000).alias("y"))
    return rounded(fitting.quadratic(p, "g"), "c0", "c1", "c2")


@query("""WITH RECURSIVE x AS (SELECT l_orderkey AS o, l_suppkey AS s FROM lineitem), e AS (SELECT DISTINCT a.s AS a, b.s AS b FROM x a JOIN x b ON a.o = b.o AND a.s <> b.s),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS id, min(b) AS component FROM r GROUP BY 1""")
def shared_vertex_components(spark, d):
    """Faces (suppliers) that share a vertex (order) are one part."""
    x = table(spark, d, "lineitem").select(c("l_orderkey").alias("vertex"), c("l_suppkey").alias("face"))
    return fitting.face_components(x)


@query()
def min_area_rectangles(spark, d):
    return fitting.min_area_rectangles(rings(spark, d))


@query()
def utm_positions(spark, d):
    zone = geo.utm_zone(c("lon"), c("lat"))
    e, n = geo.to_utm(c("lon"), c("lat"), zone)
    return fx.world(spark, d).select("pid", zone.alias("zone"), F.round(e, 3).alias("e"), F.round(n, 3).alias("n"))


ROT = geo.rotation(0.4, -0.3, 1.1)


@query(f"WITH {V} SELECT id, " + ", ".join(f"round(({r[0]!r}::DOUBLE) * x + ({r[1]!r}::DOUBLE) * y + ({r[2]!r}::DOUBLE) * z, 6) AS {n}" for r, n in zip(ROT, ("rx", "ry", "rz"))) + " FROM vec")
def rotate_points(spark, d):
    return fx.vec(spark, d).select("id", *[F.round(v, 6).alias(n) for v, n in zip(geo.rotated(ROT, c("x"), c("y"), c("z")), ("rx", "ry", "rz"))])


@query(f"WITH {V}, t AS (SELECT vec_id AS id, embedding[1]::DOUBLE + 2 AS a, embedding[2]::DOUBLE + 2.2 AS b, embedding[3]::DOUBLE + 2.1 AS c FROM embeddings) SELECT id, round((a + b + c) / 2 * ((a + b + c) / 2 - a) * ((a + b + c) / 2 - b) * ((a + b + c) / 2 - c), 6) AS area2 FROM t WHERE (a + b + c) / 2 * ((a + b + c) / 2 - a) * ((a + b + c) / 2 - b) * ((a + b + c) / 2 - c) > 0")
def triangle_area_filter(spark, d):
    e = c("embedding")
    a, b, s = (e[k].cast("double") + v for k, v in enumerate((2, 2.2, 2.1)))
    area = geo.heron_squared(a, b, s)
    return table(spark, d, "embeddings").where(area > 0).select(c("vec_id").alias("id"), F.round(area, 6).alias("area2"))


@query(f"WITH {V}, p AS (SELECT id, 1 / (1 + exp(-x)) AS p, CASE WHEN label < 5 THEN 1 ELSE 0 END AS t FROM vec) SELECT round(avg(-(t * ln(p) + (1 - t) * ln(1 - p))), 9) AS bce FROM p")
def bce_loss(spark, d):
    p = fx.vec(spark, d).select((1 / (1 + F.exp(-c("x")))).alias("p"), (c("label") < 5).cast("int").alias("t"))
    return p.agg(F.round(F.avg(-(c("t") * F.log("p") + (1 - c("t")) * F.log(1 - c("p")))), 9).alias("bce"))


