"""Token files: encoder against the library, files against plain Python, partial reads, broken files, odd inputs."""

import json
import os
import pathlib
import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geostrata.llm import queries, samples, token_files
from geostrata.session import shared_dir

VOCABULARY = f"{queries.TOKENIZERS}/word_bpe_49k.json"
LIBRARY = Tokenizer.from_file(VOCABULARY)
ENCODER = token_files.Encoder(pathlib.Path(VOCABULARY).read_text())
PIECES = ["word", "Été", "naïve.", "it's", "I'LL", "don't,", "x1y22", "«quoted»", "ΣΑΣ", "İstanbul", "ß", "Ǆ", "é", "́", "a̸=", "≠", "中文", "\U0001f600", "<|endoftext|>", "a<|startoftext|>b", " ", "\u0085", "\x1c", "\x00", "...", "''s", "?!'s", "ʼn", "ŉ", "ſ", "Ω", "ﬁ", "가", "x" * 80, "é!" * 50]


def plain(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=8), st.sampled_from(["", " ", "\n", " \t"]))
def test_words_encode_as_the_whole_text(parts, gap):
    text = gap.join(parts)
    assert np.frombuffer(ENCODER.encode(text.encode()), "<u2").tolist() == plain(text)[:-1]


def test_every_letter_and_a_mark_behind_it():
    for c in [*map(chr, range(0x20, 0x250)), "Σ", "я", "ẛ"]:
        for text in (c, f"a{c}b", f"{c}.", f"{c}̇", f"A{c}S'"):
            assert np.frombuffer(ENCODER.encode(text.encode()), "<u2").tolist() == plain(text)[:-1], text


ROWS = [(5, "hello World again"), (-2, None), (9, ""), (None, "no id"), (7, "twice"), (7, "twice"), (7, "thrice, once"), (1, "w" * 5000), (3, "many words " * 20000), (10**12, " \n")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], "doc_id long, text string, start string, ids string, H string")


def expected(rows):
    """Documents by id, nulls last; those that repeat an id as a set, since their order is by a hash."""
    out, start = {}, 0
    for i in sorted({r[0] for r in rows}, key=lambda x: (x is None, x or 0)):
        own = sorted(len(plain(t)) for j, t in rows if j == i)
        out[i] = (start, own)
        start += sum(own)
    return out


@pytest.mark.parametrize("most", [1, 1 << 26])
def test_files_against_plain_python(spark, most, monkeypatch):
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(frame(spark, ROWS), path, VOCABULARY)
    got = token_files.read(spark, path).collect()
    assert len(got) == len(ROWS)
    texts = sorted(sorted(plain(t)) for _, t in ROWS)
    assert sorted(sorted(np.frombuffer(r.ids, "<u4").tolist()) for r in got) == texts
    want = expected(ROWS)
    for i, (start, own) in want.items():
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert mine[0].start == start and sorted(r.n_tokens for r in mine) == own
        for a, b in zip(mine, mine[1:]):
            assert b.start == a.start + a.n_tokens
    some = token_files.read(spark, path, [7, 9, 12345]).collect()
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in some) == sorted((r.doc_id, r.start, bytes(r.ids)) for r in got if r.doc_id in (7, 9))
    assert token_files.read(spark, path, []).count() == 0
    with pytest.raises(Exception, match="already"):
        token_files.write(frame(spark, ROWS[:1]), path, VOCABULARY)


def test_order_of_files_and_digests(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(map(tuple, token_files.write_and_read(docs.repartition(7), VOCABULARY).collect()))
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array(plain(r.text), "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_empty_table(spark):
    assert token_files.write_and_read(frame(spark, []), VOCABULARY).count() == 0


def test_broken_files_raise(spark):
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(frame(spark, ROWS), path, VOCABULARY)
    at = path.removeprefix("file://")
    name = max((f["documents"], f["name"]) for f in json.loads(pathlib.Path(at, "manifest.json").read_text())["files"])[1]
    whole = pathlib.Path(at, name).read_bytes()
    for broken in (whole[:-1], whole[: len(whole) // 2], b"", whole[:12] + bytes(32) + whole[44:]):
        pathlib.Path(at, name).write_bytes(broken)
        with pytest.raises(Exception, match="cut short|another dictionary"):
            token_files.read(spark, path).collect()
    pathlib.Path(at, name).write_bytes(whole)
    assert token_files.read(spark, path).count() == len(ROWS)


def test_files_of_failed_tasks_are_not_read(spark):
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(frame(spark, ROWS), path, VOCABULARY)
    at = path.removeprefix("file://")
    name = next(n for n in os.listdir(at) if n.endswith(".ids"))
    pathlib.Path(at, "part-000000-0000-other.ids").write_bytes(pathlib.Path(at, name).read_bytes())
    assert token_files.read(spark, path).count() == len(ROWS)


def test_dictionary_makes_short_documents_smaller(spark):
    docs = spark.createDataFrame([(k, f"the system of record number {k % 97} was checked by the team and found to be in good order") for k in range(3000)], "doc_id long, text string")
    dictionary = token_files.train(docs, VOCABULARY)
    ids = ENCODER.encode(b"the system of record number 12345 was checked by the team and found to be in good order")
    assert dictionary and len(token_files.compressor(dictionary).compress(ids)) < 0.8 * len(token_files.compressor(b"").compress(ids))


def test_bounded_sample(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"t{k}", "a" if k % 2 else None) for k in range(20000)] + [(None, None, "b")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, rank string")
    some = samples.bounded_sample(df, 100, F.col("text"))
    got = some.collect()
    assert len(got) == 100 == len({r.text for r in got}) and some.columns == df.columns
    assert sorted(map(str, got)) == sorted(map(str, samples.bounded_sample(df.repartition(5), 100, F.col("text")).collect()))
    by = samples.bounded_sample(df, 50, F.col("doc_id"), "rank").groupBy("rank").count().collect()
    assert {r["rank"]: r["count"] for r in by} == {"a": 50, "b": 1}
    assert samples.bounded_sample(df.limit(0), 10, F.col("text")).count() == 0
