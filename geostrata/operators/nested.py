"""Search for a key at any depth of JSON documents, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.session import materialize

#: Records whose name begins so carry their own name and content in two fields.
RECORD, NAME, CONTENT = "vlr_", "description", "data"


def search(docs: DataFrame, key: str) -> DataFrame:
    """(id, path, value) of what stands under a key, at any depth, in documents (id, json); value is JSON.

    A record (a member vlr_... that describes itself as the key) gives its data. Nothing is looked for below a match. Each
    round takes all members of all documents one level down as rows, so a document's size and shape don't matter to a
    task. Null and broken documents, and those without the key, give no rows; a match that is null gives the JSON null.
    """
    spark = docs.sparkSession
    level = docs.select("id", F.lit("$").alias("path"), F.col("json").alias("text"))
    found = None
    while True:
        nodes = level.select("id", "path", F.try_parse_json("text").alias("node")).where(F.col("node").isNotNull())
        each = nodes.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        own = F.coalesce(F.col("key") == key, F.lit(False))
        record = F.coalesce(F.col("key").startswith(RECORD) & (F.try_variant_get("value", f"$.{NAME}", "string") == key), F.lit(False))
        value = F.when(own, F.to_json("value")).when(record, F.to_json(F.try_variant_get("value", f"$.{CONTENT}", "variant"))).otherwise(F.to_json("value"))
        deep = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")
        one = materialize(each.select("id", F.concat("path", step).alias("path"), value.alias("text"), (own | record).alias("hit"), deep.alias("deep")).where("hit or deep"), "nested-level")
        hits = one.where("hit and text is not null").select("id", "path", F.col("text").alias("value"))
        found = hits if found is None else found.unionByName(hits)
        level = one.where("not hit and deep")
        if level.isEmpty():
            return found
