"""Token ids in files of compressed documents, as a Spark data source, and an encoder for the texts.

Format "token_ids": a folder of part files, a zstandard dictionary that all share, and a manifest. The ids of a
document are one zstandard frame of its own, made with the shared dictionary, so a short document is
small on its own and is read without its neighbours. A part file is

    header    magic, version, bytes an id, SHA-256 of the dictionary
    frames    one a document, ids as little-endian unsigned integers of 2 or 4 bytes
    index     doc_id (int64), null flag (uint8), n_tokens (int64), frame offset (int64, one more than documents)
    footer    place of the index, documents, tokens, magic

The manifest lists the part files in order with their documents, tokens and least and greatest ids. It is
written when the job commits, so files of failed or repeated tasks are never read. A reader checks lengths, magics and
the dictionary's hash, takes each document's start from sums over the manifest, and with the option
"ids" opens only files, and reads only frames, that hold these documents.

Encoding: ids of the words between ASCII white space follow each other, as no token, and no rule of the vocabulary
in use, reaches across white space. So each worker encodes a word once and keeps the result (bounded).

The dictionary is trained on the ids of at most SAMPLE_DOCS distinct texts of at most SAMPLE_CHARS characters,
chosen by hash. It changes sizes, never results; where there is too little to train on, it is empty.

Nulls: a null text is empty, so its document has the end id alone; documents with a null id come last. Rows that
repeat an id each count, ordered by a hash of their text. Very long texts are one frame. A word that is very long is
encoded whole and not kept. An empty table gives no rows. Columns of the input beyond id and text aren't read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from geostrata.llm.samples import bounded_sample
from geostrata.session import shared_dir

#: Fixed values of the format.
MAGIC, VERSION = b"TOKENIDS", 1
HEADER, FOOTER = struct.Struct("<8sHH32s"), struct.Struct("<QQQ8s")
DICTIONARY, MANIFEST = "dictionary.zstd", "manifest.json"
LEVEL, DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 3, 65536, 1000, 16384
#: A part file is closed beyond so many bytes of frames or documents, a batch beyond so many bytes of ids.
FILE_BYTES, FILE_DOCS, BATCH_BYTES = 1 << 26, 1 << 19, 1 << 22
#: Words kept by a worker, and the longest that is kept.
MOST_WORDS, LONGEST_WORD = 600_000, 64
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below this code point neither combine nor change with their neighbours in the vocabulary's rules.
PLAIN_BELOW, OTHER = "ɐ", "￿"


class Encoder(dict):
    """Words (bytes) to their ids (little-endian, of width bytes)."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.model = self.tokenizer.model
        self.letters = self.plain_letters() if json.loads(spec)["pre_tokenizer"] else {}

    def plain_letters(self) -> dict[int, str]:
        """What the vocabulary's own rules make of single letters; OTHER for letters that they take apart."""
        out = {}
        for c in map(chr, range(ord(PLAIN_BELOW))):
            if c.isalpha():
                whole = self.tokenizer.normalizer.normalize_str(c)
                pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(whole)
                out[ord(c)] = pieces[0][0] if len(pieces) == 1 and len(whole) == 1 else OTHER
        return out

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > LONGEST_WORD:
            return self.encode_word(word)
        if len(self) >= MOST_WORDS:
            self.clear()
        out = self[word] = self.encode_word(word)
        return out

    def encode_word(self, word: bytes) -> bytes:
        text = word.decode()
        stem = text.rstrip(ASCII_PUNCTUATION)
        if stem.isalpha():
            # letters alone are one piece, and the punctuation behind them is others
            piece = stem.translate(self.letters)
            if max(piece) < PLAIN_BELOW:
                out = self.pack([t.id for t in self.model.tokenize(piece)])
                return out + self[text[len(stem) :].encode()] if len(stem) < len(text) else out
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole text."""
        return b"".join(map(self.__getitem__, text.split()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The worker's encoder for a vocabulary; one at a time is kept from task to task."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def encoded(docs: DataFrame, vocabulary: str, end_id: int | None) -> DataFrame:
    """doc_id, ids (binary, 2 or 4 bytes each) of rows (doc_id, text), in their order; width as the vocabulary needs."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        end = b"" if end_id is None else enc.pack([end_id])
        rows, size = [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                text = text.as_buffer()
                ids = (enc.encode(text.to_pybytes()) if text is not None else b"") + end
                rows.append((doc_id.as_py(), ids))
                size += len(ids)
                if size > BATCH_BYTES:
                    yield packed(rows, schema)
                    rows, size = [], 0
        yield packed(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    return fs.FileSystem.from_uri(path)


def read_bytes(path: str, name: str) -> bytes:
    system, at = place(path)
    with system.open_input_stream(f"{at}/{name}") as f:
        return f.read()


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: for each file, name, documents, tokens, least and greatest id (null where it has none)."""

    task: int
    files: list[dict]


class TokenWriter(DataSourceArrowWriter):
    """Writes rows (doc_id, ids), in the order of partitions and rows, as part files."""

    def __init__(self, path: str, width: int) -> None:
        self.path, self.width = path, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, at = place(self.path)
        dictionary = read_bytes(self.path, DICTIONARY)
        compress = compressor(dictionary)
        task = TaskContext.get().partitionId()
        part, out = Part(task, []), None
        for batch in iterator:
            for doc_id, ids in zip(batch.column(0), batch.column(1)):
                if out is None:
                    out = PartFile(system, at, f"part-{task:06d}-{len(part.files):04d}-{uuid.uuid4().hex}.ids", self.width, dictionary)
                out.add(doc_id.as_py(), ids.as_py() or b"", compress)
                if out.full():
                    part.files.append(out.close())
                    out = None
        if out is not None:
            part.files.append(out.close())
        return part

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        system, at = place(self.path)
        body = json.dumps({"version": VERSION, "files": [f for m in parts for f in m.files]})
        with system.open_output_stream(f"{at}/_{MANIFEST}") as f:
            f.write(body.encode())
        system.move(f"{at}/_{MANIFEST}", f"{at}/{MANIFEST}")

    def abort(self, messages: list[Part | None]) -> None:
        system, at = place(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                system.delete_file(f"{at}/{f['name']}")


class PartFile:
    """One part file while it is written; keeps the index, some 25 bytes a document."""

    def __init__(self, system: fs.FileSystem, at: str, name: str, width: int, dictionary: bytes) -> None:
        self.name, self.width = name, width
        self.out = system.open_output_stream(f"{at}/{name}")
        self.out.write(HEADER.pack(MAGIC, VERSION, width, hashlib.sha256(dictionary).digest()))
        self.ids: list[int | None] = []
        self.tokens: list[int] = []
        self.offsets = [HEADER.size]

    def add(self, doc_id: int | None, ids: bytes, compress: zstandard.ZstdCompressor) -> None:
        frame = compress.compress(ids)
        self.out.write(frame)
        self.ids.append(doc_id)
        self.tokens.append(len(ids) // self.width)
        self.offsets.append(self.offsets[-1] + len(frame))

    def full(self) -> bool:
        return self.offsets[-1] >= FILE_BYTES or len(self.ids) >= FILE_DOCS

    def close(self) -> dict:
        known = [i for i in self.ids if i is not None]
        self.out.write(np.array([i or 0 for i in self.ids], "<i8").tobytes())
        self.out.write(np.array([i is None for i in self.ids], np.uint8).tobytes())
        self.out.write(np.array(self.tokens, "<i8").tobytes() + np.array(self.offsets, "<i8").tobytes())
        n = sum(self.tokens)
        self.out.write(FOOTER.pack(self.offsets[-1], len(self.ids), n, MAGIC))
        self.out.close()
        return {"name": self.name, "documents": len(self.ids), "tokens": n, "nulls": len(self.ids) - len(known), "least": min(known, default=None), "greatest": max(known, default=None)}


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


@dataclass
class File(InputPartition):
    name: str
    start: int
    documents: int
    tokens: int


class TokenReader(DataSourceReader):
    """Reads part files, one a task: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit integers)."""

    def __init__(self, path: str, wanted: list[int] | None) -> None:
        self.path, self.wanted = path, wanted

    def partitions(self) -> list[File]:
        files, start = [], 0
        for f in json.loads(read_bytes(self.path, MANIFEST))["files"]:
            hit = self.wanted is None or (f["least"] is not None and any(f["least"] <= w <= f["greatest"] for w in self.wanted))
            if hit:
                files.append(File(f["name"], start, f["documents"], f["tokens"]))
            start += f["tokens"]
        # a source must have a partition; one without a name is empty
        return files or [File("", 0, 0, 0)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        dictionary = read_bytes(self.path, DICTIONARY)
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        system, at = place(self.path)
        with system.open_input_file(f"{at}/{partition.name}") as f:
            width, index = opened(f, dictionary, partition)
            doc_ids, null, tokens, offsets = index
            starts = partition.start + np.cumsum(tokens) - tokens
            use = np.arange(len(doc_ids)) if self.wanted is None else np.flatnonzero(np.isin(doc_ids, self.wanted) & (null == 0))
            rows, size = [], 0
            f.seek(HEADER.size)
            for k in use:
                if self.wanted is not None:
                    f.seek(offsets[k])
                ids = expand.decompress(f.read(offsets[k + 1] - offsets[k]))
                if len(ids) != width * tokens[k]:
                    raise ValueError(f"{partition.name}: a frame of document {k} doesn't hold its tokens")
                ids = ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                rows.append((None if null[k] else int(doc_ids[k]), int(starts[k]), int(tokens[k]), ids))
                size += len(ids)
                if size > BATCH_BYTES:
                    yield packed(rows, SCHEMA)
                    rows, size = [], 0
            yield packed(rows, SCHEMA)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def opened(f: pa.NativeFile, dictionary: bytes, expected: File) -> tuple[int, tuple[np.ndarray, ...]]:
    """Bytes an id, and the index, of a part file that is whole and of this dictionary."""
    size = f.size()
    if size < HEADER.size + FOOTER.size:
        raise ValueError(f"{expected.name} is cut short")
    magic, version, width, digest = HEADER.unpack(f.read(HEADER.size))
    f.seek(size - FOOTER.size)
    at, n, tokens, end = FOOTER.unpack(f.read(FOOTER.size))
    if (magic, version, end) != (MAGIC, VERSION, MAGIC) or size != at + 25 * n + 8 + FOOTER.size or (n, tokens) != (expected.documents, expected.tokens):
        raise ValueError(f"{expected.name} is cut short or not of this format")
    if digest != hashlib.sha256(dictionary).digest():
        raise ValueError(f"{expected.name} was written with another dictionary")
    f.seek(at)
    ids, null, tokens = np.frombuffer(f.read(8 * n), "<i8"), np.frombuffer(f.read(n), np.uint8), np.frombuffer(f.read(8 * n), "<i8")
    return width, (ids, null, tokens, np.frombuffer(f.read(8 * n + 8), "<i8"))


class TokenIds(DataSource):
    """Format token_ids. Options: path; to write, width (bytes an id, 2 or 4); to read, ids (comma-separated, only these documents)."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> TokenReader:
        wanted = self.options.get("ids")
        return TokenReader(self.options["path"], None if wanted is None else [int(x) for x in wanted.split(",") if x.strip()])

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        system, at = place(self.options["path"])
        if system.get_file_info(f"{at}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError("the folder has token files already; write to a new one")
        return TokenWriter(self.options["path"], int(self.options.get("width", "4")))


def train(docs: DataFrame, vocabulary: str) -> bytes:
    """A dictionary for the ids of texts like these."""
    short = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("doc_id", "text")
    some = bounded_sample(short, SAMPLE_DOCS, F.col("text"))
    samples = sorted(bytes(r.ids) for r in encoded(some, vocabulary, None).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small
        return b""


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all texts to a new folder, in ascending order of doc_id."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenIds)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dictionary = train(docs, vocabulary)
    system, at = place(path)
    system.create_dir(at, recursive=True)
    with system.open_output_stream(f"{at}/{DICTIONARY}") as f:
        f.write(dictionary)
    # rows that are equal in id and text go to several tasks by their place in the input, which changes no result
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = docs.select("*", order[1].alias("h"), order[2].alias("place"))
    keys = [order[0], F.col("h"), F.col("place")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    width = encoder(Path(vocabulary).read_text()).width
    encoded(rows, vocabulary, end_id).write.format("token_ids").option("path", path).option("width", width).mode("append").save()


def read(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of all documents, or of those with these ids (others aren't read)."""
    spark.dataSource.register(TokenIds)
    reader = spark.read.format("token_ids").option("path", path)
    return (reader if ids is None else reader.option("ids", ",".join(map(str, ids)))).load()


def write_and_read(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from files in the shared folder."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, vocabulary)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
