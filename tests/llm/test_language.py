"""Held-out accuracy, the hierarchy, and texts without letters."""

import numpy as np
from pyspark.sql import functions as F

from geostrata.llm import language
from geostrata.session import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.fit(docs.select("doc_id", "text", "lang"))
    assert ("family germanic", "family romance") in model.duels
    got = language.identify(docs, model).where(~language.is_train(F.col("doc_id"))).select("lang", "lang_pred", "score").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_odd_texts(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = language.fit(docs.select("doc_id", "text", "lang"))
    rows = [(1, None, None), (2, "", None), (3, "12 34 !", None), (4, "der die und nicht " * 30_000, None), (5, "a", "x"), (5, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[4].lang_pred == "de"
    assert language.identify(df, None).where("lang_pred <> 'und'").count() == 0
    assert language.fit(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))) is None


def test_duel_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 20)).astype(np.float32)
    y = np.where(x[:, 3] + 0.5 * x[:, 7] > 0, 1.0, -1.0).astype(np.float32)
    w, b, slope = language.fit_duel(x, y)
    assert ((x @ w + b > 0) == (y > 0)).mean() > 0.95 and slope > 0


def test_a_repeated_id_takes_one_place_of_the_sample(spark):
    """A third of the rows have one id; the driver gets at most the bound a language, and the rest still counts."""
    from geostrata.llm import language

    words = {"aa": "the cat sat on the mat", "bb": "le chat est sur la table"}
    rows = [(7 if k % 3 == 0 else 10_000 + k, f"{words[x]} {k}", x) for x in words for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, old = [], type(df).toPandas
    try:
        type(df).toPandas = lambda self: seen.append(out := old(self)) or out
        language.fit(df, 40)
    finally:
        type(df).toPandas = old
    assert len(seen) == 1 and 60 <= len(seen[0]) <= 80 and not seen[0].duplicated(["lang", "h"]).any()
