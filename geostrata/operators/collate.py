"""Names, collections, tags, ranking, histograms, sequences and weighted sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.functions.geometry import box_overlap
from geostrata.operators.running import running_sum

#: Fixed value: modality codes between the prefix and the trail of an image's file name.
NAME = r"^(.*)-(P1BS|M1BS|A1BS)-([0-9]+_[0-9]+_P[0-9]+)(.*)\.([A-Z]+)$"


def parse_names(files: DataFrame) -> DataFrame:
    """(name, prefix, modality, trail, ext) of upper-case image file names."""
    return files.select("name", *[F.regexp_extract("name", NAME, k).alias(n) for n, k in (("prefix", 1), ("modality", 2), ("trail", 3), ("ext", 5))])


def collections(rows: DataFrame) -> DataFrame:
    """(id, image, rpc, info) from rows (id, part, file)."""
    return rows.groupBy("id").pivot("part", ["image", "rpc", "info"]).agg(F.max("file"))


def complete(c: DataFrame, rpc: bool = True, info: bool = False) -> DataFrame:
    need = F.col("image").isNotNull()
    need = need & F.col("rpc").isNotNull() if rpc else need
    return c.where(need & F.col("info").isNotNull() if info else need)


def paired(images: DataFrame, files: DataFrame) -> DataFrame:
    """Each image's camera file by stem, or by stem with _0."""
    a = files.select(F.col("stem"), F.col("path").alias("exact"))
    b = files.select(F.regexp_replace("stem", "_0$", "").alias("stem"), F.col("path").alias("zero")).where(F.col("zero").contains("_0."))
    return images.join(a, "stem", "left").join(b, "stem", "left").select(*images.columns, F.coalesce("exact", "zero").alias("rpc"))


def ranked(images: DataFrame, order: list[str]) -> DataFrame:
    """Rank over a table of images: metadata rows, one each, so a single window is bounded by the number of images."""
    return images.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def best_image(images: DataFrame, dsms: DataFrame, size: float = 11) -> DataFrame:
    """(dsm, path, area): the image that covers most of each surface; then least cloud, angle, path.

    Boxes meet in cells as large as a surface, each pair in the first cell that both have.
    """
    box = (F.col("ax"), F.col("ay"), F.col("ax") + size, F.col("ay") + size)
    area = box_overlap(tuple(F.col(c) for c in ("minx", "miny", "maxx", "maxy")), box)
    at = lambda c: F.floor(c / F.lit(float(size)))
    cells = lambda df, lo, hi, n: df.withColumn(n, F.explode(F.sequence(at(lo), at(hi))))
    a = cells(cells(images, F.col("minx"), F.col("maxx"), "cx"), F.col("miny"), F.col("maxy"), "cy")
    b = cells(cells(dsms, box[0], box[2], "cx"), box[1], box[3], "cy")
    first = (F.col("cx") == at(F.greatest("minx", "ax"))) & (F.col("cy") == at(F.greatest("miny", "ay")))
    pairs = a.join(b, ["cx", "cy"]).where(first).withColumn("area", area).where("area > 0")
    rank = F.row_number().over(Window.partitionBy("dsm").orderBy(F.desc("area"), "cloud", "angle", "path"))
    return pairs.withColumn("r", rank).where("r = 1").select("dsm", "path", "area")


def road_class(tags: DataFrame) -> DataFrame:
    """Add class and type: the first of highway and railway that is there."""
    cls = F.when(F.col("highway").isNotNull(), "highway").when(F.col("railway").isNotNull(), "railway")
    return tags.withColumn("class", cls).withColumn("type", F.coalesce("highway", "railway"))


def hstore(text: Column) -> Column:
    """A map from text like "a"=>"b","c"=>"d"."""
    return F.from_json(F.concat(F.lit("{"), F.regexp_replace(text, "=>", ":"), F.lit("}")), "map<string,string>")


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) over the range of values; the last bin is closed."""
    b = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
    return rows.crossJoin(F.broadcast(b)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def gap_clusters(rows: DataFrame, key: str, place: Column, order: list[str], gap: float) -> DataFrame:
    """Add cluster: numbered from 1 in each key, a new one after every gap."""
    w = Window.partitionBy(key).orderBy(*order)
    p = rows.withColumn("__p", place)
    new = F.when(F.lag("__p").over(w).isNull() | (F.col("__p") - F.lag("__p").over(w) > gap), 1).otherwise(0)
    keep = [c for c in rows.columns if c not in order or c == order[-1]]
    return p.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*keep, "cluster")


def voxel_means(points: DataFrame, size: tuple[float, float, float]) -> DataFrame:
    cell = [F.floor(F.col(c) / F.lit(s)).alias(n) for c, s, n in zip("xyz", size, "ijk")]
    return points.groupBy(*cell).agg(*[F.avg(c).alias(c) for c in "xyz"])


def sample_by_weight(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(k, id): for each u of queries the first item whose running weight reaches u times the total.

    Running sums come in levels of blocks of ids; items and queries meet in equal parts of the total, so neither a
    window nor a join spans all items. A weight that reaches over several parts is in each of them.
    """
    n, total = items.agg(F.count(F.lit(1)), F.sum("w")).first()
    if not total:
        return queries.select("k").where("false").withColumn("id", F.lit(None).cast(items.schema["id"].dataType))
    parts = max(1, n // 1024)
    part = lambda c: F.least(F.floor(c * parts / F.lit(total)), F.lit(parts - 1))
    cum = running_sum(items.where("w > 0"), "id", "w", "cum").select("id", "cum", (F.col("cum") - F.col("w")).alias("prev"))
    # a little wider than the parts, so that rounding loses no meeting
    slack = F.lit(total * 1e-12)
    cum = cum.withColumn("part", F.explode(F.sequence(part(F.greatest(F.col("prev") - slack, F.lit(0.0))), part(F.col("cum") + slack))))
    wanted = queries.select("k", (F.col("u") * total).alias("t")).withColumn("part", part(F.col("t")))
    hit = cum.join(wanted, "part").where((F.col("cum") >= F.col("t")) & (F.col("prev") < F.col("t") + slack))
    return hit.groupBy("k").agg(F.min("id").alias("id"))


def surviving_bins(counts: DataFrame, share: float) -> DataFrame:
    """Rows (bin, n) of a histogram with more than a share of the largest count. One row of the largest is broadcast."""
    top = counts.agg(F.max("n").alias("top"))
    return counts.crossJoin(F.broadcast(top)).where(F.col("n") > F.lit(share) * F.col("top")).select("bin", "n")
