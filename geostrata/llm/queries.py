"""The queries opN_<name> over the test tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm import chat, decontamination, fill_middle, hard_negatives, language, line_templates, lm_scoring, media, mixing, ngram_join, token_counts, token_files, toxicity
from geostrata.session import table

#: Folder of the public vocabularies.
TOKENIZERS = "/opt/tokenizers"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 5-word shingles at a similarity of 0.8."""
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of templates that recur in at least three documents."""
    return line_templates.drop_recurring(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs.select("doc_id", "text"), language.fit(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", (~language.is_train(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op4_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as 8-bit sound in a deduplicated chunk store, read back."""
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, before and after three edits of each."""
    docs = token_counts.three_edits(table(spark, sf_dir, "documents"))
    return token_counts.count_with_edits(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of four fifths of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (~toxicity.is_train(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learned from six sevenths of the ids."""
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op10_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, repaired and rendered."""
    return chat.repair(table(spark, sf_dir, "conversations"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weights 5, 2, 1 by source, 150 % of all words, at most two epochs."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents after the fill-in-middle transformation, and of the texts rebuilt from it."""
    return fill_middle.digests(fill_middle.transform(table(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, searched among all."""
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")))


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to files with a shared dictionary and read back."""
    return token_files.write_and_read(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_line_templates": op2_line_templates,
    "op3_language_id": op3_language_id,
    "op4_media_chunks": op4_media_chunks,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_source_mixing": op9_source_mixing,
    "op10_chat_repair": op10_chat_repair,
    "op11_fill_middle": op11_fill_middle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_ids": op13_token_ids,
}
SQL = {
    "op1_ngram_join": ngram_join.components_sql(),
    "op2_line_templates": line_templates.drop_recurring_sql(),
    "op5_decontamination": decontamination.leaks_sql(),
    "op9_source_mixing": mixing.mix_sql(),
    "op11_fill_middle": fill_middle.digests_sql(),
    "op12_hard_negatives": hard_negatives.mine_sql(),
}
