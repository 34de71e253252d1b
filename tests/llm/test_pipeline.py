"""The stages on one small folder: columns, effects of decisions, agreement of run() with the stages."""

import numpy as np

import corpus_pipeline
from geostrata.llm import decontamination, ngram_join
from geostrata.session import materialize, table
from tests.llm.test_native import many_templates

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "source_mixing"]
    docs = table(spark, DIR, "documents")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "1234 5678", "en", "s", 9), (9004, "le la des une est", None, None, 17)], docs.schema)
    docs = docs.unionByName(odd)
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, docs, DIR), "test")
        if k < 4:
            assert out.columns == columns
            ids = {r.doc_id for r in out.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
            seen.append(len(ids))
            docs = out
    assert 9004 in ids and not ids & {9001, 9002, 9003}
    assert ngram_join.components(docs).where("doc_id <> component_id").count() == 0
    assert decontamination.leaks(docs, table(spark, DIR, "benchmark")).count() == 0
    assert out.count() == docs.count() and set(out.columns) >= {"doc_id", "size", "target", "taken"}
    assert seen[0] > seen[-1]


def test_odd_rows_of_each_stage(spark):
    """Null ids, repeated ids with other texts, clashing column names, an empty table."""
    long = " the quick brown fox and the lazy dog are in the old house by the river with all the others "
    word = lambda n: "w" + "".join(chr(97 + int(d)) for d in str(n))
    text = lambda k: " ".join(word(x) for x in np.random.default_rng(k).integers(0, 99_999, 60)) + long + word(k)
    rows = [(k, text(k), "en", "s", 10, "mine", 0.25) for k in range(40)]
    rows += [(5, text(5), "en", "s", 10, "mine", 0.25), (6, text(900), "en", "s", 10, "mine", 0.25), (None, text(5), "en", "s", 10, "mine", 0.25), (77, text(7), "en", "s", 10, "mine", 0.25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, lang_pred string, score double")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = materialize(stage(spark, docs, DIR), "test")
        assert out.columns == docs.columns and {(r.lang_pred, r.score) for r in out.collect()} == {("mine", 0.25)}
        assert out.where("doc_id is null").count() == 1
        if k == 2:
            assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == list(range(40))
        else:
            assert out.count() == len(rows)
        assert stage(spark, docs.limit(0), DIR).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == len(rows)


def test_line_dedup_drops_every_template_of_a_leaf(spark):
    """Seven templates with fields in one leaf: all documents but each template's first lose their only line and go."""
    rows, want = many_templates()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_recurring_lines(spark, docs, DIR).collect()}
    assert kept == {r[0] for r in rows} - want
