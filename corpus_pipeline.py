"""The corpus pipeline: language ID, line dedup, n-gram join, decontamination, mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on every row that the
stage before kept and returns a DataFrame. All but the last return the columns of documents. run()
writes each stage's result as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm import decontamination, language, line_templates, mixing, ngram_join
from geostrata.llm.columns import fresh
from geostrata.session import materialize, table


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``und`` (null text, or no letter) goes. lang becomes the predicted language where it is null.

    Null ids are never learned from, and go through like others. Repeated rows stay as they are. Without any
    labelled text nothing can be told, so nothing stays. Columns of the input keep their values.
    """
    told = fresh(docs, "lang"), fresh(docs, "score")
    named = language.identify(docs, language.fit(docs.select("doc_id", "text", "lang")), told)
    return named.where(F.col(told[0]) != "und").withColumn("lang", F.coalesce("lang", told[0])).select(*docs.columns)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines and pieces of recurring templates, n_chars anew. A document that loses all its words goes.

    A null text passes; rows with a null id keep their lines; rows that repeat an id are documents of their own.
    """
    lines, dropped, cut = (fresh(docs, n) for n in ("lines", "dropped", "cut"))
    out = line_templates.clean(docs, names=(lines, dropped, cut))
    blank = F.trim(F.translate("text", "\t\n\r\f\x0b", "     ")) == ""
    same = F.col(dropped) + F.col(cut) == 0
    out = out.where(same | ~blank)
    return out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by 5-word shingles, the one with the smallest id.

    Rows that repeat an id are one document; of them the row whose text has the least hash stays. A row with a
    null id can't be told from others by its id: it stays.
    """
    firsts = ngram_join.components(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(firsts, "doc_id", "left_semi")
    n = fresh(docs, "rows")
    repeated = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).select("doc_id")
    rank = F.struct(F.xxhash64("text"), F.col("text"))
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), rank).alias(n)).select(f"{n}.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one).unionByName(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Rows that repeat an id go together; rows with a null id stay."""
    bad = decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document. Null texts have size 0; rows with a null or repeated id each count, sampled by their texts."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_recurring_lines),
    ("ngram_join", keep_one_of_near_duplicates),
    ("decontamination", drop_leaks),
    ("source_mixing", mix_sources),
]

#: The first stage's classifier can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
