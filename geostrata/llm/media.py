"""Media columns: payloads stored as 8-bit sound in a deduplicated store of content-defined chunks.

The payload of a text is its UTF-8 bytes with zero bytes up to a positive multiple of 64. Its stored
form is a mono WAV file of 8-bit samples. A gear hash rolls over the file's bytes and cuts it where ten
hash bits are zero, in chunks of 256 to 4096 bytes, so that near copies share most chunks.

Files with the same payload are one object. The digests of all objects' chunks are joined in Spark: a
chunk that only one object has goes to that object's pack (its private chunks, compressed together), a
chunk that several have is stored once, in the shared part, by the object with the least digest. A small
dictionary, fitted on a bounded sample and stored beside the packs, serves their compression. The
manifest of an object is its ordered list of chunks. Reading back joins shared chunks to the packs
that list them, sorts packs and chunks by object and place, reads them one object at a time, verifies both
digests and computes features of the samples.

Digests travel, bytes mostly don't. Bit filters over digests, sized by their number, tell on the map side
which chunks are shared, which object stores one, and which row stands for copies, so packs go from their
text straight to the store. A filter lets some more pass than it should: such a chunk is stored as a shared
one with one user. What several rows may store (packs of objects with copies, shared chunks) is made
unique by a shuffle of these alone.

Nulls: a null text is an empty payload (64 zero bytes). A null id gives a row like others. Repeated rows
and ids each give a row. An empty table gives none. Very long texts are processed one at a time. Further
columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.arrowtext import chunks, table64, utf8
from geostrata.llm.filters import bit_filter, passes
from geostrata.session import discard, materialize

#: Bounds of a chunk's bytes, hash bits that are zero at a cut, size of a WAV header, payload unit.
LEAST_CHUNK, MOST_CHUNK, CUT_BITS, HEADER, UNIT = 256, 4096, 10, 44, 64
GEAR = (table64(256, 41) >> np.uint64(32)).astype(np.uint32)
#: Compressed bytes of a batch, compression level, bytes and sampled texts of the dictionary.
BATCH_BYTES, LEVEL, DICTIONARY_BYTES, SAMPLE = 2_000_000, 12, 32_768, 800


def wav_header(n: int, rate: int = 8000) -> bytes:
    """Header of a mono 8-bit WAV file with n samples."""
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n)


def samples(media: bytes) -> bytes:
    """The payload that a WAV file holds."""
    (n,) = struct.unpack_from("<I", media, 40)
    if media[:4] != b"RIFF" or n != len(media) - HEADER:
        raise ValueError("not a stored payload")
    return media[HEADER:]


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling gear hash over the 32 bytes that end at each place: sum of table values shifted by age."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cuts(candidates: np.ndarray, begin: int, end: int) -> list[int]:
    """Ends of the chunks of bytes begin..end, given the places after which the hash allows a cut."""
    out, at = [], begin
    while end - at > LEAST_CHUNK:
        k = int(np.searchsorted(candidates, at + LEAST_CHUNK))
        nxt = int(candidates[k]) if k < len(candidates) else end
        at = min(nxt, at + MOST_CHUNK, end)
        out.append(at)
    if at < end:
        out.append(end)
    return out


def stored(texts: pa.Array) -> Iterator[tuple[int, int, bytes, list[int]]]:
    """(row, bytes of the text, WAV file, lengths of its chunks) of each text."""
    data, off = utf8(texts)
    for lo, hi, part, o in chunks(data, off):
        files = []
        for k in range(hi - lo):
            body = part[o[k] : o[k + 1]].tobytes()
            size = max(UNIT, -(-len(body) // UNIT) * UNIT)
            files.append(wav_header(size) + body + b"\0" * (size - len(body)))
        flat = np.frombuffer(b"".join(files), np.uint8)
        allowed = np.flatnonzero(gear(flat) >> np.uint32(32 - CUT_BITS) == 0) + 1
        at = 0
        for k, f in enumerate(files):
            ends = cuts(allowed, at, at + len(f))
            yield lo + k, int(o[k + 1] - o[k]), f, np.diff([at, *ends]).tolist()
            at += len(f)


def parts_of(media: bytes, lengths: list[int]) -> list[bytes]:
    at, out = 0, []
    for n in lengths:
        out.append(media[at : at + n])
        at += n
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def objects_of(texts: pa.Array) -> Iterator[bytes]:
    """SHA-256 of each text's payload."""
    data, off = utf8(texts)
    for lo, hi in zip(off.tolist(), off[1:].tolist()):
        size = max(UNIT, -(-(hi - lo) // UNIT) * UNIT)
        h = hashlib.sha256(data[lo:hi])
        h.update(bytes(size - (hi - lo)))
        yield h.digest()


def short(objects: list[bytes]) -> np.ndarray:
    """The leading 64 bits of digests."""
    return np.frombuffer(b"".join(o[:8] for o in objects), np.int64)


def manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, object, the object's leading bits h, n_bytes, digests, their leading bits."""
    for b in batches:
        obj, n, digests, leading = [], [], [], []
        for _, size, media, lengths in stored(b.column("text")):
            obj.append(hashlib.sha256(samples(media)).digest())
            n.append(size)
            digests.append([digest(c) for c in parts_of(media, lengths)])
            leading.append(short(digests[-1]))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(obj, pa.binary()), pa.array(short(obj)), pa.array(n, pa.int64()), pa.array(digests, pa.list_(pa.binary())), pa.array(leading, pa.list_(pa.int64()))],
            ["doc_id", "object", "h", "n_bytes", "digests", "leading"],
        )


def let_through(special):
    """For mapInArrow: the hashes r of rows (h, r) whose h may be in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            use = passes(special.value, b.column("h").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("r").filter(pa.array(use))], ["h"])

    return run


def train(docs: DataFrame, n: int) -> bytes:
    """A compression dictionary from at most SAMPLE texts chosen by hash, whole ones of 200 to 20,000 characters; empty where they are too few."""
    some = docs.where(F.length("text").between(200, 20_000)).select("text", F.xxhash64(F.lit("media"), "text").alias("h"))
    share = min(1.0, SAMPLE / max(1, n))
    got = some.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000).dropDuplicates(["h"]).orderBy("h").limit(SAMPLE).toPandas()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [t.encode() for t in got.text]).as_bytes()
    except zstandard.ZstdError:
        return b""


def codec(dictionary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


STORE = pa.schema([("shared", pa.bool_()), ("key", pa.binary()), ("n_chunks", pa.int32()), ("foreign", pa.list_(pa.int32())), ("uses", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("blob", pa.binary())])
STORED = "shared boolean, key binary, n_chunks int, foreign array<int>, uses array<binary>, lengths array<int>, blob binary"


def stowed(dictionary: bytes, filters, copied: bool):
    """For mapInArrow: store rows (a pack an object, and shared chunks that the object stores) of objects with copies, or of the others.

    filters: broadcast bit filters: objects with copies; rows that stand for one; shared chunks; (chunk, object) that store one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, _ = codec(dictionary)
        special, firsts, common, owners = filters.value
        sent: set[bytes] = set()
        for b in batches:
            objects = list(objects_of(b.column("text")))
            h = short(objects)
            use = passes(special, h)
            use = np.flatnonzero(use & passes(firsts, h ^ b.column("d").to_numpy()) if copied else ~use)
            rows, size = [], 0
            for k, _, media, lengths in stored(b.column("text").take(pa.array(use))):
                obj = objects[use[k]]
                if copied and obj in sent:
                    continue
                if copied:
                    sent.add(obj)
                parts = parts_of(media, lengths)
                digests = [digest(c) for c in parts]
                leading = short(digests)
                out = passes(common, leading)
                foreign = np.flatnonzero(out).tolist()
                own = b"".join(c for c, o in zip(parts, out) if not o) if foreign else media
                rows.append((False, obj, len(parts), foreign, [digests[i] for i in foreign], [n for n, o in zip(lengths, out) if not o], z.compress(own)))
                for i in np.flatnonzero(out & passes(owners, leading ^ h[use[k]])).tolist():
                    if digests[i] not in sent:
                        sent.add(digests[i])
                        rows.append((True, digests[i], 1, [], [], [lengths[i]], z.compress(parts[i])))
                size += len(rows[-1][6]) + len(own) // 4
                if size > BATCH_BYTES:
                    yield store_batch(rows)
                    rows, size = [], 0
            yield store_batch(rows)

    return run


def store_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(STORE.names, r)) for r in rows], STORE)


BACK = pa.schema([("object", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("verified", pa.bool_())])


def told(unz: zstandard.ZstdDecompressor, obj: bytes, n: int, lengths: list[int], blob: bytes, got: dict[int, bytes]) -> tuple:
    """A row of BACK: an object's chunks in order, verified, with their features."""
    own = unz.decompress(blob)
    if got:
        mine = iter(parts_of(own, lengths))
        own = b"".join(got[k] if k in got else next(mine) for k in range(n))
    payload = samples(own)
    sha = hashlib.sha256(payload)
    return obj, len(payload), sha.hexdigest(), zlib.crc32(payload[-UNIT:]), len(own), hashlib.sha256(own).hexdigest(), feature(payload, n), sha.digest() == obj


def back_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(BACK.names, r)) for r in rows], BACK)


def read_back(dictionary: bytes):
    """For mapInArrow: objects from rows sorted by (key, seq): a pack (seq -1), then the shared chunks that it lists. One object is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unz = codec(dictionary)
        pack, got = None, {}
        for b in batches:
            rows = []
            for obj, seq, n, lengths, blob in zip(*(b.column(c) for c in ("key", "seq", "n_chunks", "lengths", "blob"))):
                if seq.as_py() >= 0:
                    got[seq.as_py()] = unz.decompress(blob.as_py())
                    continue
                if pack:
                    rows.append(told(unz, *pack, got))
                pack, got = (obj.as_py(), n.as_py(), lengths.as_py(), blob.as_py()), {}
            yield back_batch(rows)
        if pack:
            yield back_batch([told(unz, *pack, got)])

    return run


def feature(payload: bytes, n_chunks: int) -> str:
    """Whole numbers, so equal on any machine: sum and sum of squares of samples, crossings of the middle, chunks."""
    x = np.frombuffer(payload, np.uint8)
    wide = x.astype(np.int64)
    high = x >= 128
    return f"sum={int(wide.sum())};squares={int(wide @ wide)};crossings={int(np.count_nonzero(high[1:] != high[:-1]))};chunks={n_chunks}"


def store_and_read(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store all payloads and read them back: doc_id, n_bytes, the digests, the features, verified."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    listed = materialize(base.mapInArrow(manifest, f"doc_id {kind}, object binary, h long, n_bytes long, digests array<binary>, leading array<long>"), "media-manifest")
    # one row stands for each object; the others are links to it
    objects = materialize(listed.groupBy("h", "object").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows")), "media-objects")
    refs = listed.select("h", F.explode(F.arrays_zip("digests", "leading")).alias("c")).select("h", F.col("c.digests").alias("digest"), F.col("c.leading").alias("leading"))
    stores = refs.groupBy("digest", "leading").agg(F.min("h").alias("owner"), F.max("h").alias("other"))
    stores = materialize(stores.select(F.col("leading").alias("h"), F.col("leading").bitwiseXOR(F.col("owner")).alias("r"), (F.col("owner") != F.col("other")).alias("several")), "media-chunks")

    def through(rows: DataFrame, words: np.ndarray) -> np.ndarray:
        return bit_filter(rows.select("h", "r").mapInArrow(let_through(spark.sparkContext.broadcast(words)), "h long"))

    special, common = bit_filter(objects.where("rows > 1").select("h")), bit_filter(stores.where("several").select("h"))
    firsts = objects.select("h", F.col("h").bitwiseXOR(F.xxhash64("doc_id")).alias("r"))
    filters = spark.sparkContext.broadcast((special, through(firsts, special), common, through(stores, common)))

    dictionary = train(base, listed.count())
    saved = materialize(spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary"), "media-dictionary")
    texts = base.select(F.xxhash64("doc_id").alias("d"), "text")
    alone = materialize(texts.mapInArrow(stowed(dictionary, filters, False), STORED), "media-store", ("shared",))
    copied = texts.mapInArrow(stowed(dictionary, filters, True), STORED)
    once = materialize(copied.unionByName(alone.where("shared").select(*copied.columns)).dropDuplicates(["shared", "key"]), "media-store-once", ("shared",))

    reading = read_back(bytes(saved.first()[0]))  # what a reader of the store finds beside it
    packs = alone.where("not shared").unionByName(once.where("not shared"))
    common_chunks = once.where("shared").select(F.col("key").alias("digest"), F.col("blob").alias("chunk"))
    pack = ("key", F.lit(-1).alias("seq"), "n_chunks", "lengths", "blob")
    whole = packs.where(F.size("foreign") == 0).select(*pack)
    mixed = packs.where(F.size("foreign") > 0)
    asked = mixed.select("key", F.explode(F.arrays_zip("foreign", "uses")).alias("u")).select("key", F.col("u.foreign").alias("seq"), F.col("u.uses").alias("digest"))
    brought = asked.join(common_chunks, "digest").select("key", "seq", F.lit(None).cast("int").alias("n_chunks"), F.lit(None).cast("array<int>").alias("lengths"), F.col("chunk").alias("blob"))
    # a pack and its chunks meet as rows in order, so no value holds all chunks of an object
    mixed = mixed.select(*pack).unionByName(brought).repartition("key").sortWithinPartitions("key", "seq")
    back = "object binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, verified boolean"
    read = materialize(whole.mapInArrow(reading, back).unionByName(mixed.mapInArrow(reading, back)), "media-read")
    for done in (objects, stores):
        discard(done)
    return listed.select("doc_id", "object", "n_bytes").join(read, "object").drop("object")
