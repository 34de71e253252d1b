"""Meshes as text: PLY and OBJ readers and writers, offset headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.sources import register


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(mesh_id, line number from 0, line) of whole files."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("mesh_id"), F.split("value", "\r?\n").alias("l"))
    return t.select("mesh_id", F.posexplode("l").alias("n", "line"))


def _numbers(line: Column, kind: str = "double") -> Column:
    return F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != ""), lambda t: t.cast(kind))


@register("ply", "mesh")
def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (mesh_id, vid, x, y, z) and faces (mesh_id, fid, idx) of ASCII PLY files."""
    lines = _lines(spark, path)
    head = lines.groupBy("mesh_id").agg(
        F.min(F.when(F.trim("line") == "end_header", F.col("n"))).alias("end"),
        F.max(F.regexp_extract("line", r"^element vertex (\d+)", 1).try_cast("long")).alias("nv"),
        F.max(F.regexp_extract("line", r"^element face (\d+)", 1).try_cast("long")).alias("nf"),
    )
    body = lines.join(head, "mesh_id").withColumn("k", F.col("n") - F.col("end") - 1)
    v = body.where("k >= 0 and k < nv").withColumn("a", _numbers(F.col("line")))
    f = body.where("k >= nv and k < nv + nf").withColumn("a", _numbers(F.col("line"), "int"))
    vertices = v.select("mesh_id", F.col("k").alias("vid"), *[F.col("a")[i].alias(c) for i, c in enumerate("xyz")])
    return vertices, f.select("mesh_id", (F.col("k") - F.col("nv")).alias("fid"), F.slice("a", F.lit(2), F.col("a")[0]).alias("idx"))


@register("obj", "mesh")
def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of OBJ files; ids count from 0, indices after a slash are ignored."""
    lines = _lines(spark, path)
    rank = lambda kind: F.sum(F.col("line").startswith(kind).cast("int")).over(w) - 1
    from pyspark.sql import Window

    w = Window.partitionBy("mesh_id").orderBy("n")
    v = lines.where(F.col("line").startswith("v ")).withColumn("vid", rank("v ")).withColumn("a", _numbers(F.expr("substring(line, 3)")))
    f = lines.where(F.col("line").startswith("f ")).withColumn("fid", rank("f "))
    idx = F.transform(F.filter(F.split(F.expr("substring(line, 3)"), r"\s+"), lambda t: t != ""), lambda t: F.split(t, "/")[0].cast("int") - 1)
    return v.select("mesh_id", "vid", *[F.col("a")[i].alias(c) for i, c in enumerate("xyz")]), f.select("mesh_id", "fid", idx.alias("idx"))


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(mesh_id, x, y, z): offsets from header lines like "#x offset: 12.5"; 0 where a file has none."""
    lines = _lines(spark, path).where("n < 8")
    pick = lambda c: F.max(F.regexp_extract("line", rf"^#\s*{c}(?: offset)?:?\s*([-+0-9.eE]+)", 1).try_cast("double"))
    return lines.groupBy("mesh_id").agg(*[F.coalesce(pick(c), F.lit(0.0)).alias(c) for c in "xyz"])


def obj_lines(vertices: DataFrame, faces: DataFrame, offset: tuple[float, float, float] = (0, 0, 0)) -> DataFrame:
    """(part, k, line) of an OBJ file with an offset header, in order of (part, k); vertices (vid, x, y, z), faces (fid, idx)."""
    spark = vertices.sparkSession
    head = spark.createDataFrame([(0, k, f"#{c} offset: {o}") for k, (c, o) in enumerate(zip("xyz", offset))], "part int, k long, line string")
    v = vertices.select(F.lit(1).alias("part"), F.col("vid").alias("k"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("line"))
    f = faces.select(F.lit(2).alias("part"), F.col("fid").alias("k"), F.concat(F.lit("f "), F.array_join(F.transform("idx", lambda i: (i + 1).cast("string")), " ")).alias("line"))
    return head.unionByName(v).unionByName(f)


def write_obj(vertices: DataFrame, faces: DataFrame, path: str, offset: tuple[float, float, float] = (0, 0, 0)) -> None:
    """One ordered text part a range of lines; parts in name order are the file."""
    lines = obj_lines(vertices, faces, offset)
    lines.orderBy("part", "k").select("line").write.text(path)


def boundary_edges(faces: DataFrame) -> DataFrame:
    """(a, b) edges, a < b, that only one face has."""
    nxt = F.concat(F.slice("idx", F.lit(2), F.size("idx")), F.slice("idx", F.lit(1), F.lit(1)))
    pairs = faces.select(F.explode(F.zip_with("idx", nxt, lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")))).alias("e"))
    return pairs.groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("a", "b")
