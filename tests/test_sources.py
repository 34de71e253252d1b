"""Round trips of text formats, the stream, the steps, the model hook."""

import numpy as np
from pyspark.sql import functions as F

from geostrata.functions import models
from geostrata.plans.steps import Steps
from geostrata.sources import clouds, meshes, metadata, reader
from geostrata.streaming import grid

PLY = """ply
format ascii 1.0
element vertex 4
property float x
property float y
property float z
element face 2
property list uchar int vertex_indices
end_header
0 0 0
1 0 0
1 1 0
0 1 2.5
3 0 1 2
3 0 2 3
"""


def test_ply_and_obj(spark, tmp_path):
    (tmp_path / "a.ply").write_text(PLY)
    v, f = reader("a.ply", "mesh")(spark, str(tmp_path / "a.ply"))
    assert v.count() == 4 and v.where("vid = 3").first().z == 2.5
    assert sorted(tuple(r.idx) for r in f.collect()) == [(0, 1, 2), (0, 2, 3)]
    assert sorted((r.a, r.b) for r in meshes.boundary_edges(f).collect()) == [(0, 1), (0, 3), (1, 2), (2, 3)]
    meshes.write_obj(v, f, str(tmp_path / "o"), (1.5, 2, 3))
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    (tmp_path / "b.obj").write_text(text)
    v2, f2 = meshes.read_obj(spark, str(tmp_path / "b.obj"))
    assert sorted((r.vid, r.x, r.y, r.z) for r in v2.collect()) == sorted((r.vid, r.x, r.y, r.z) for r in v.collect())
    assert sorted(tuple(r.idx) for r in f2.collect()) == [(0, 1, 2), (0, 2, 3)]
    o = meshes.read_offsets(spark, str(tmp_path / "b.obj")).first()
    assert (o.x, o.y, o.z) == (1.5, 2.0, 3.0)


def test_clouds_and_lists(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 3.5), (4.0, 5.0, -6.0)], clouds.XYZ)
    clouds.write_points(df, str(tmp_path / "p"))
    assert sorted(tuple(r) for r in clouds.read_points(spark, str(tmp_path / "p")).collect()) == [(1.0, 2.0, 3.5), (4.0, 5.0, -6.0)]
    (tmp_path / "ids.txt").write_text("a1 # first\n\n# none\nb2\n")
    assert sorted(r.id for r in clouds.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["a1", "b2"]


def test_metadata(spark, tmp_path):
    (tmp_path / "x.IMD").write_text('absCalFactor = 0.5;\nname = "B";\nabsCalFactor = 0.7;\nEND;\n')
    md = metadata.read_imd(spark, str(tmp_path / "x.IMD")).first().md
    assert md["absCalFactor"] == ["0.5", "0.7"] and md["name"] == ["B"]
    ring = [(1, [(1, 2), (3, 4), (5, 6)])]
    metadata.write_kw18(spark.createDataFrame(ring, "id int, r array<struct<x:int,y:int>>"), str(tmp_path / "k"))
    assert "".join(p.read_text() for p in (tmp_path / "k").glob("part-*")) == "1 0 1 3 1 2 3 4 5 6\n"


def test_stream_equals_batch(spark, tmp_path):
    pts = spark.range(1000).select((F.col("id") % 40).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"), F.col("id").cast("double").alias("z"))
    pts.repartition(4).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = grid.grid_max(s, 10, 2).writeStream.outputMode("complete").format("memory").queryName("surface").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("surface").collect())) == sorted(map(tuple, grid.grid_max(pts, 10, 2).collect()))


def test_steps_go_on(spark, tmp_path):
    ran = []

    def make(name, f):
        return lambda *a: (ran.append(name), f(*a))[1]

    chain = lambda: Steps(spark, str(tmp_path)).add("a", make("a", lambda: spark.range(3))).add("b", make("b", lambda a: a.selectExpr("id + 1 as id")), "a")
    assert sorted(r.id for r in chain().run()["b"].collect()) == [1, 2, 3]
    chain().run()
    assert ran == ["a", "b"]
    chain().run(force=("b",))
    assert ran == ["a", "b", "b"]


def test_model_hook(spark):
    f = models.predictor(lambda: lambda x: x * 2)
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "a array<double>")
    assert sorted(r[0] for r in df.select(f("a")).collect()) == [[2.0, 4.0], [6.0, 8.0]]
    assert np.isclose(df.select(models.sigmoid_mean(F.array(F.lit(1.0), F.lit(-1.0)))).first()[0], 0.5)
