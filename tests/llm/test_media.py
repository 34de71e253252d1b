"""Chunks, store and read-back against plain computations."""

import hashlib
import zlib

import numpy as np

from geostrata.llm import media


def payload(text):
    b = (text or "").encode()
    return b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))


def test_gear_by_definition():
    x = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    h = 0
    for i, b in enumerate(x):
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        if i >= 31:
            assert int(media.gear(x[: i + 1])[i]) == h


def test_round_trip(spark):
    rng = np.random.default_rng(2)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(500)]
    long = " ".join(rng.choice(words, 4000))
    texts = [None, "", "a", "é" * 40, "x" * 64, long, long, long[:9000] + "EDIT" + long[9000:], "z" * 50_000, long[5000:]]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(5, long, "extra")]
    got = media.store_and_read(spark.createDataFrame(rows, "doc_id long, text string, digest string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        p = payload(texts[r.doc_id])
        m = media.wav_header(len(p)) + p
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((texts[r.doc_id] or "").encode()), len(p), hashlib.sha256(p).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256, r.verified) == (zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), True)
    assert len({r.feature for r in got if r.doc_id in (5, 6)}) == 1


def test_near_copies_share_chunks():
    rng = np.random.default_rng(3)
    a = bytes(rng.integers(97, 123, 60_000).astype(np.uint8)).decode()
    import pyarrow as pa

    sets = [{media.digest(c) for c in media.parts_of(m, n)} for _, _, m, n in media.stored(pa.array([a, a[:30_000] + "!" + a[30_000:]]))]
    assert len(sets[0] & sets[1]) > 0.8 * len(sets[0])


def test_filters_that_let_all_pass(spark, monkeypatch):
    """Two bits a filter: nearly every object counts as special, and nothing may be lost."""
    from geostrata.llm import filters

    monkeypatch.setattr(filters, "LEAST_BITS", 6)
    monkeypatch.setattr(filters, "MOST_BITS", 6)
    rows = [(k if k % 5 else None, f"text {k % 70} " * (k % 9)) for k in range(200)]
    got = media.store_and_read(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted((str(i), hashlib.sha256(payload(t)).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.payload_sha256) for r in got) == want and all(r.verified for r in got)


def test_a_chunk_that_a_third_has(spark):
    r = np.random.default_rng(5)
    text = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    hot = text(6000)
    rows = [(k, hot + text(300) if k % 3 == 0 else hot if k % 3 == 1 and k > 300 else text(500)) for k in range(600)]
    got = media.store_and_read(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.payload_sha256 for x in got} == {i: hashlib.sha256(payload(t)).hexdigest() for i, t in rows}


def test_reading_holds_one_object_at_a_time():
    """A pack and its shared chunks are rows of their own, in any cut into batches."""
    import pyarrow as pa

    z, _ = media.codec(b"")
    rows, want = [], []
    for i in range(5):
        p = payload(f"text {i} " * 300)
        m = media.wav_header(len(p)) + p
        parts = [m[:700], m[700:1500], m[1500:]]
        own = [0, 2] if i % 2 else [0, 1, 2]
        key = hashlib.sha256(p).digest()
        rows.append((key, -1, 3, [len(parts[k]) for k in own], z.compress(b"".join(parts[k] for k in own))))
        rows += [(key, k, None, None, z.compress(parts[k])) for k in range(3) if k not in own]
        want.append(hashlib.sha256(p).hexdigest())
    schema = pa.schema([("key", pa.binary()), ("seq", pa.int32()), ("n_chunks", pa.int32()), ("lengths", pa.list_(pa.int32())), ("blob", pa.binary())])
    for size in (1, 2, 100):
        batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[k : k + size]], schema) for k in range(0, len(rows), size)]
        got = [r for b in media.read_back(b"")(iter(batches)) for r in b.to_pylist()]
        assert [r["payload_sha256"] for r in got] == want and all(r["verified"] for r in got)


def test_empty(spark):
    assert media.store_and_read(spark.createDataFrame([], "doc_id long, text string")).count() == 0
