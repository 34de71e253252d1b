"""LAS point clouds as a Spark data source: read by ranges of records, written a file a task with a commit.

Reading: a file's header gives the layout, the number of records and their bounds. Records have a fixed length, so a
file is cut into ranges of SPLIT_POINTS records, each a task of its own that reads only its bytes. Only the
columns of the given schema are decoded. With the option "box" (minx,miny,maxx,maxy) files whose bounds lie
outside aren't opened again, and records outside are dropped before they reach Spark; comparisons of x,
y, z with constants that Spark pushes down do the same, where spark.sql.python.filterPushdown.enabled is set.

Writing: each task buffers at most FILE_POINTS points, writes them as a hidden file with its bounds, and the commit
renames the files of the tasks that succeeded, so a repeated or failed task leaves nothing that is read.

Versions 1.0 to 1.3 with point formats 0 to 3 are read; version 1.2 with format 2 is written. Files that are
compressed, cut short or of another format raise an error. Coordinates are integers times a scale plus an offset,
so a value comes back within half a scale of what was written; null coordinates can't be written, other nulls become 0.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from geostrata.sources import register

#: The header of versions 1.0 to 1.3, and the records of formats 0 to 3.
HEADER = struct.Struct("<4sHH16sBB32s32sHHHIIBHI5I12d")
RECORD = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("source_id", "<u2")]
GPS, COLOURS = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
FORMATS = {0: RECORD, 1: RECORD + GPS, 2: RECORD + COLOURS, 3: RECORD + GPS + COLOURS}
SCHEMA = "x double, y double, z double, intensity int, classification int, return_number int, n_returns int, scan_angle int, user_data int, source_id int, gps_time double, red int, green int, blue int"
AXES = "xyz"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SPLIT_POINTS, BATCH_POINTS, FILE_POINTS = 1 << 20, 1 << 16, 1 << 20


@dataclass
class Header:
    """What a file says about its points."""

    name: str
    offset: int
    length: int
    kind: int
    points: int
    scale: tuple[float, ...]
    shift: tuple[float, ...]
    least: tuple[float, ...]
    most: tuple[float, ...]

    @classmethod
    def of(cls, name: str, head: bytes, size: int) -> Header:
        if len(head) < HEADER.size or head[:4] != b"LASF":
            raise ValueError(f"{name} isn't a LAS file")
        v = HEADER.unpack(head[: HEADER.size])
        offset, kind, length, points = v[11], v[13], v[14], v[15]
        if kind not in FORMATS or v[4] != 1 or v[5] > 3:
            raise ValueError(f"{name}: version {v[4]}.{v[5]} with point format {kind} can't be read")
        if length < np.dtype(FORMATS[kind]).itemsize or size < offset + points * length:
            raise ValueError(f"{name} is cut short")
        d = v[21:]
        return cls(name, offset, length, kind, points, d[0:3], d[3:6], (d[7], d[9], d[11]), (d[6], d[8], d[10]))

    def dtype(self) -> np.dtype:
        fields = FORMATS[self.kind]
        rest = self.length - np.dtype(fields).itemsize
        return np.dtype([*fields, ("rest", f"V{rest}")]) if rest else np.dtype(fields)


@dataclass
class Range(InputPartition):
    header: Header | None
    first: int
    count: int


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def files_of(path: str) -> list[str]:
    """The paths of the .las files of a folder, in order, or of one file."""
    system, at = place(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [at]
    found = (i.path for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File)
    return sorted(p for p in found if p.lower().endswith(".las") and p.rpartition("/")[2][0] not in "._")


class LasReader(DataSourceReader):
    """limits: by axis, the (least, greatest) values that are wanted."""

    def __init__(self, path: str, schema: StructType, limits: dict[str, tuple[float, float]], split: int) -> None:
        self.path, self.names, self.limits, self.split = path, schema.fieldNames(), limits, split
        self.schema = pa.schema([(f.name, {"double": pa.float64(), "int": pa.int32()}[f.dataType.simpleString()]) for f in schema])

    def partitions(self) -> list[Range]:
        system, _ = place(self.path)
        out = []
        for p in files_of(self.path):
            size = system.get_file_info(p).size
            with system.open_input_file(p) as f:
                h = Header.of(p, f.read(min(size, HEADER.size)), size)
            apart = any(hi < h.least[k] or lo > h.most[k] for k, a in enumerate(AXES) for lo, hi in [self.limits.get(a, (-math.inf, math.inf))])
            if h.points and not apart:
                out += [Range(h, at, min(self.split, h.points - at)) for at in range(0, h.points, self.split)]
        return out or [Range(None, 0, 0)]  # a source must have a partition

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        h = partition.header
        if h is None:
            return
        system, _ = place(self.path)
        with system.open_input_file(h.name) as f:
            f.seek(h.offset + partition.first * h.length)
            for at in range(0, partition.count, BATCH_POINTS):
                n = min(BATCH_POINTS, partition.count - at)
                body = f.read(n * h.length)
                if len(body) < n * h.length:
                    raise ValueError(f"{h.name} is cut short")
                yield self.decoded(h, np.frombuffer(body, h.dtype()))

    def decoded(self, h: Header, r: np.ndarray) -> pa.RecordBatch:
        axis = lambda a: r[a.upper()] * h.scale[AXES.index(a)] + h.shift[AXES.index(a)]
        if self.limits:
            use = np.ones(len(r), bool)
            for a, (lo, hi) in self.limits.items():
                v = axis(a)
                use &= (v >= lo) & (v <= hi)
            r = r[use]
        bits = {"return_number": (0, 7), "n_returns": (3, 7)}
        cols = []
        for name, kind in zip(self.names, self.schema.types):
            if name in AXES:
                v = axis(name)
            elif name in bits:
                v = (r["flags"] >> bits[name][0]) & bits[name][1]
            elif name == "classification":
                v = r[name] & 31
            elif name in r.dtype.names:
                v = r[name]
            else:
                cols.append(pa.nulls(len(r), kind))
                continue
            cols.append(pa.array(v.astype(kind.to_pandas_dtype()), kind))
        return pa.RecordBatch.from_arrays(cols, schema=self.schema)


class PushingReader(LasReader):
    """Spark refuses this method where pushing filters down is switched off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of x, y, z with numbers narrow the limits; Spark checks all filters again."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in AXES and isinstance(f.value, (int, float)):
                lo, hi = self.limits.get(f.attribute[0], (-math.inf, math.inf))
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    lo = max(lo, f.value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    hi = min(hi, f.value)
                self.limits[f.attribute[0]] = lo, hi
            yield f


@dataclass
class Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class LasWriter(DataSourceArrowWriter):
    """Version 1.2, point format 2. Offsets are the least whole coordinates of a file."""

    def __init__(self, path: str, scale: tuple[float, ...]) -> None:
        self.path, self.scale = path, scale

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out, kept, n = Written(), [], 0
        for b in iterator:
            while len(b):
                some = b.slice(0, FILE_POINTS - n)
                kept.append(some)
                n += len(some)
                b = b.slice(len(some))
                if n == FILE_POINTS:
                    out.names.append(self.file(kept))
                    kept, n = [], 0
        if n:
            out.names.append(self.file(kept))
        return out

    def file(self, batches: list[pa.RecordBatch]) -> str:
        t = pa.Table.from_batches(batches)
        r = np.zeros(t.num_rows, np.dtype(FORMATS[2]))
        least, most, shift = [], [], []
        for k, a in enumerate(AXES):
            if t.column(a).null_count:
                raise ValueError(f"a null {a} can't be written")
            v = t.column(a).to_numpy().astype(np.float64)
            off = math.floor(v.min())
            whole = np.round((v - off) / self.scale[k])
            if not (np.abs(whole) < 2**31).all():
                raise ValueError(f"{a} spans too much for its scale, {self.scale[k]}")
            r[a.upper()] = whole
            shift.append(off)
            least.append(r[a.upper()].min() * self.scale[k] + off)
            most.append(r[a.upper()].max() * self.scale[k] + off)
        for name in t.column_names:
            if name in r.dtype.names:
                v = t.column(name).fill_null(0).to_numpy()
                r[name] = np.clip(v, np.iinfo(r.dtype[name]).min, np.iinfo(r.dtype[name]).max)
        r["classification"] &= 31
        r["flags"] = 1 | 1 << 3  # the first of one return
        ends = [v for k in range(3) for v in (most[k], least[k])]
        head = HEADER.pack(b"LASF", 0, 0, b"", 1, 2, b"", b"geostrata", 1, 2000, HEADER.size, HEADER.size, 0, 2, r.dtype.itemsize, len(r), len(r), 0, 0, 0, 0, *self.scale, *shift, *ends)
        name = f"part-{uuid.uuid4().hex}.las"
        system, at = place(self.path)
        with system.open_output_stream(f"{at}/_{name}") as f:
            f.write(head)
            f.write(r.tobytes())
        return name

    def commit(self, messages: list[Written | None]) -> None:
        system, at = place(self.path)
        for m in messages:
            for name in m.names if m is not None else []:
                system.move(f"{at}/_{name}", f"{at}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, at = place(self.path)
        for m in messages:
            for name in m.names if m is not None else []:
                system.delete_file(f"{at}/_{name}")


class Las(DataSource):
    """Format las. To read: path (file or folder), box, split (records a task), pushdown (true: take Spark's comparisons). To write: path, scale (one, or one for each of x, y, z)."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LasReader:
        box = self.options.get("box")
        limits = {}
        if box:
            x0, y0, x1, y1 = map(float, box.split(","))
            limits = {"x": (x0, x1), "y": (y0, y1)}
        kind = PushingReader if self.options.get("pushdown") == "true" else LasReader
        return kind(self.options["path"], schema, limits, int(self.options.get("split", SPLIT_POINTS)))

    def writer(self, schema: StructType, overwrite: bool) -> LasWriter:
        missing = {*AXES} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"points need the columns {sorted(missing)}")
        scale = [float(v) for v in self.options.get("scale", "0.001").split(",")]
        system, at = place(self.options["path"])
        system.create_dir(at, recursive=True)
        return LasWriter(self.options["path"], tuple(scale * 3 if len(scale) == 1 else scale))


@register("las", "points")
def read_las(spark: SparkSession, path: str, columns: str = SCHEMA, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Points of a LAS file, or of a folder of them: the columns given as a schema, inside the box (minx, miny, maxx, maxy)."""
    spark.dataSource.register(Las)
    reader = spark.read.format("las").schema(columns).option("path", path).option("pushdown", spark.conf.get(PUSHDOWN, "false"))
    return (reader if box is None else reader.option("box", ",".join(map(str, box)))).load()


def write_las(points: DataFrame, path: str, scale: tuple[float, ...] = (0.001,)) -> None:
    """Write x, y, z and those of intensity, classification, scan_angle, user_data, source_id, red, green, blue that points has, as LAS files in a folder."""
    points.sparkSession.dataSource.register(Las)
    points.write.format("las").option("path", path).option("scale", ",".join(map(str, scale))).mode("append").save()
