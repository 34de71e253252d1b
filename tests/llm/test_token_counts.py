"""Counts after edits against counting the edited text anew."""

import random

import public_tokenizers
import tiktoken  # noqa: F401

from geostrata.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def random_text(r, n):
    return "".join(r.choice(["the", "un", "io", " ", " ", "  ", "\n", "\n\n", "42", "7", "é", "ß", "'s", "'ll", "...", "&&", "\t", "x", "日本"]) for _ in range(n))


def test_edits_equal_recount():
    r, count = random.Random(7), tc.Counter(PATH)
    full = tc.encoder(PATH).encode_ordinary
    for size in (0, 1, 5, 200, 3000):
        for _ in range(12):
            text = random_text(r, size)
            doc = tc.Document(text, count)
            assert doc.n_tokens == len(full(text))
            for _ in range(8):
                a = r.randrange(len(text) + 1)
                b = min(len(text), a + r.choice([0, 1, 3, 40, 400]))
                new = random_text(r, r.choice([0, 1, 2, 30]))
                text = text[:a] + new + text[b:]
                doc.edit(a, b, new)
                assert doc.text_of(0, len(doc.leaves)) == text
                assert doc.n_tokens == len(full(text)), (a, b, new)


def test_only_touched_leaves_are_encoded():
    count = tc.Counter(PATH)
    doc = tc.Document("word and more " * 20_000, count)
    before = doc.encoded
    doc.edit(100_000, 100_004, "other")
    assert doc.encoded - before <= 6 * tc.LEAF


def test_frames(spark):
    docs = spark.createDataFrame([(1, "a b c", 0), (2, None, 0), (3, "", 0), (4, "x " * 50_000, 0), (5, "keep", 0), (5, "keep", 0)], "doc_id long, text string, seq int")
    edits = spark.createDataFrame([(1, 1, 0, 1, "zz"), (1, 2, 4, None, None), (2, 1, 5, 9, "new text"), (99, 1, 0, 0, "lost"), (4, 1, -3, 10**6, "gone")], "doc_id long, seq int, start int, end int, replacement string")
    got = {r.doc_id: r for r in tc.count_with_edits(tc.with_edits(docs, edits), PATH).collect()}
    full = tc.encoder(PATH).encode_ordinary
    assert got[1].n_tokens_after == len(full("zz b c")) and got[2].n_tokens_after == len(full("new text"))
    assert (got[3].n_tokens, got[5].n_tokens_after, got[4].n_tokens_after) == (0, len(full("keep")), len(full("gone")))
    assert tc.count_with_edits(tc.three_edits(docs), PATH).count() == 6
    assert tc.count_with_edits(tc.three_edits(docs.limit(0)), PATH).count() == 0
