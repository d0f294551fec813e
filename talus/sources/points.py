"""Point-cloud files as a Spark data source: many tasks read one PLY or LAS file by ranges of its records, and many tasks write one PLY file.

Reading. The header is read once, by the planner; binary points are records of one length, so a partition is a range of records, and a task reads its
bytes in chunks. Only the columns of the given schema are built from their places in the record: with x, y and z alone nothing else is touched. Text PLY has lines
of any length: each file is one partition, read a chunk of lines at a time. Files are opened by path or through the file systems that pyarrow
knows by their URI.

Writing. Rows come as blocks of bytes with their place in the file, which sums of sizes have given beforehand (``files.write_ply``). A task writes its blocks at
their places in one temporary file beside the goal; an attempt that runs again, or beside another, writes the same bytes at the same place. The file gets its name
at commit, when all blocks are there; a failed write leaves nothing."""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Fixed values of the formats.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
LAS_COLOUR = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
LAS_TIME = {1: 20, 3: 20, 4: 20, 5: 20, 6: 22, 7: 22, 8: 22, 9: 22, 10: 22}
#: (name, byte, first bit, bits) of the packed fields and (name, byte, type) of the whole ones, for formats 0 to 5 and 6 to 10.
LAS_BITS = (
    [
        ("return_number", 14, 0, 3),
        ("number_of_returns", 14, 3, 3),
        ("scan_direction_flag", 14, 6, 1),
        ("edge_of_flight_line", 14, 7, 1),
        ("classification", 15, 0, 5),
        ("synthetic", 15, 5, 1),
        ("key_point", 15, 6, 1),
        ("withheld", 15, 7, 1),
    ],
    [
        ("return_number", 14, 0, 4),
        ("number_of_returns", 14, 4, 4),
        ("synthetic", 15, 0, 1),
        ("key_point", 15, 1, 1),
        ("withheld", 15, 2, 1),
        ("overlap", 15, 3, 1),
        ("scanner_channel", 15, 4, 2),
        ("scan_direction_flag", 15, 6, 1),
        ("edge_of_flight_line", 15, 7, 1),
    ],
)
LAS_FIELDS = (
    [("intensity", 12, "<u2"), ("scan_angle_rank", 16, "i1"), ("user_data", 17, "u1"), ("point_source_id", 18, "<u2")],
    [("intensity", 12, "<u2"), ("classification", 16, "u1"), ("user_data", 17, "u1"), ("scan_angle", 18, "<i2"), ("point_source_id", 20, "<u2")],
)
#: A point's id is its place in its file, over the file's place among the sorted paths; records of a chunk; bytes of a partition.
FILE_BITS, ROWS_AT_ONCE, SPLIT = 40, 50_000, 64 << 20
SCHEMA = "path string, pid long, x double, y double, z double, red short, green short, blue short, extra map<string,double>"
_ARROW = {"path": pa.string(), "pid": pa.int64(), "x": pa.float64(), "y": pa.float64(), "z": pa.float64(), "red": pa.int16(), "green": pa.int16(), "blue": pa.int16(), "extra": pa.map_(pa.string(), pa.float64())}


def opened(path: str):
    """A file that can be read and sought."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        return fs.open_input_file(at)
    return open(path, "rb")


@dataclass(frozen=True)
class Field:
    """Where a value is in a record: its byte and type; of packed ones the first bit and their number; scale and offset of LAS coordinates."""

    at: int
    kind: str
    first: int = 0
    bits: int = 0
    scale: float = 1.0
    offset: float = 0.0

    def of(self, raw: np.ndarray) -> np.ndarray:
        size = np.dtype(self.kind).itemsize
        v = np.ascontiguousarray(raw[:, self.at : self.at + size]).view(self.kind).ravel()
        if self.bits:
            return (v >> self.first & (1 << self.bits) - 1).astype(float)
        return v.astype(float) * self.scale + self.offset if (self.scale, self.offset) != (1.0, 0.0) else v.astype(float)


@dataclass(frozen=True)
class Layout:
    """What a header says: first byte and number of the records, their length (0: lines of text), and their fields by lower-case name."""

    start: int
    n: int
    length: int
    fields: tuple[tuple[str, Field], ...]


def ply_layout(f) -> Layout:
    head = b""
    while b"end_header" not in head or b"\n" not in head[head.index(b"end_header") :]:
        more = f.read(1 << 16)
        if not more:
            raise ValueError("PLY: no end_header")
        head += more
    end = head.index(b"\n", head.index(b"end_header")) + 1
    lines = [x.split() for x in head[:end].decode("ascii", "replace").split("\n")]
    order = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[next(x for x in lines if x[:1] == ["format"])[1]]
    elements: list[tuple[str, int, list[tuple[str, str]]]] = []
    for x in lines:
        if x[:1] == ["element"]:
            elements.append((x[1], int(x[2]), []))
        elif x[:1] == ["property"]:
            if x[1] == "list" and elements[-1][0] == "vertex":
                raise ValueError("PLY: list properties of vertices aren't supported")
            elements[-1][2].append((x[-1], x[1]))
    if not elements or elements[0][0] != "vertex":
        raise ValueError("PLY: the first element must be vertex")
    at, fields = 0, []
    for i, (name, kind) in enumerate(elements[0][2]):
        fields.append((name.lower(), Field(at if order else i, (order or "<") + PLY_TYPES[kind])))
        at += np.dtype(PLY_TYPES[kind]).itemsize
    return Layout(end, elements[0][1], at if order else 0, tuple(fields))


def las_layout(f) -> Layout:
    head = f.read(375)
    if head[:4] != b"LASF":
        raise ValueError("LAS: bad signature")
    if head[104] & 0xC0:
        raise RuntimeError("LAZ: compressed points need a codec that isn't installed")
    kind, length = head[104] & 0x3F, struct.unpack_from("<H", head, 105)[0]
    start, n = struct.unpack_from("<I", head, 96)[0], struct.unpack_from("<I", head, 107)[0]
    if head[25] >= 4 and not n:
        n = struct.unpack_from("<Q", head, 247)[0]
    scale, offset, new = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155), int(kind >= 6)
    fields = [(c, Field(4 * i, "<i4", scale=scale[i], offset=offset[i])) for i, c in enumerate("xyz")]
    fields += [(name, Field(at, t)) for name, at, t in LAS_FIELDS[new]] + [(name, Field(at, "u1", first, bits)) for name, at, first, bits in LAS_BITS[new]]
    if kind in LAS_TIME:
        fields.append(("gps_time", Field(LAS_TIME[kind], "<f8")))
    if kind in LAS_COLOUR:
        fields += [(f"{c}_16", Field(LAS_COLOUR[kind] + 2 * i, "<u2")) for i, c in enumerate(("red", "green", "blue"))]
    if kind in (8, 10):
        fields.append(("nir", Field(36, "<u2")))
    return Layout(start, n, length, tuple(fields))


def table(path: str, first: int, get, names: list[str], n: int, columns: list[str]) -> pa.RecordBatch:
    """Records as rows; ``get`` gives a field's values."""

    def column(c: str) -> pa.Array:
        if c == "path":
            return pa.array([path] * n, pa.string())
        if c == "pid":
            return pa.array(np.arange(first, first + n))
        if c == "extra":
            rest = sorted(set(names) - {"x", "y", "z", "red", "green", "blue"})
            items = np.stack([get(k) for k in rest], axis=1).ravel() if rest else np.zeros(0)
            keys = pa.DictionaryArray.from_arrays(np.tile(np.arange(len(rest), dtype=np.int32), n), pa.array(rest, pa.string())).cast(pa.string())
            return pa.MapArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(rest), keys, pa.array(items))
        if c in names:
            return pa.array(get(c)).cast(_ARROW[c], safe=False)
        return pa.nulls(n, _ARROW[c])

    return pa.RecordBatch.from_arrays([column(c) for c in columns], names=columns)


@dataclass
class Records(InputPartition):
    path: str
    number: int
    layout: Layout
    first: int
    n: int


class PointReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.paths, self.las, self.split = options["paths"].split("\n"), options["kind"] == "las", int(options.get("split", SPLIT))
        self.columns = columns

    def partitions(self) -> list[Records]:
        out = []
        for number, path in enumerate(self.paths):
            with opened(path) as f:
                layout = (las_layout if self.las else ply_layout)(f)
            if not {"x", "y", "z"} <= {k for k, _ in layout.fields}:
                raise ValueError(f"{path}: x, y and z are needed")
            step = max(1, self.split // layout.length) if layout.length else max(1, layout.n)
            out += [Records(path, number, layout, at, min(step, layout.n - at)) for at in range(0, layout.n, step)]
        return out or [Records("", 0, Layout(0, 0, 1, ()), 0, 0)]

    def read(self, part: Records):
        layout, fields = part.layout, dict(part.layout.fields)
        if not part.n:
            return
        with opened(part.path) as f:
            f.seek(layout.start + part.first * layout.length)
            for at in range(part.first, part.first + part.n, ROWS_AT_ONCE):
                n = min(ROWS_AT_ONCE, part.first + part.n - at)
                if not layout.length:
                    values = np.loadtxt([f.readline() for _ in range(n)], ndmin=2)
                    get = lambda c: values[:, fields[c].at]  # noqa: E731, B023
                else:
                    raw = np.frombuffer(f.read(n * layout.length), np.uint8).reshape(n, layout.length)
                    get = lambda c: fields[c].of(raw)  # noqa: E731, B023
                yield table(part.path, (part.number << FILE_BITS) + at, get, list(fields), n, self.columns)


class PointFiles(DataSource):
    """Options: paths (one a line), kind (ply or las), split (bytes of a partition). The schema is any part of SCHEMA; LAS gives colours as they are in extra."""

    @classmethod
    def name(cls) -> str:
        return "talus_points"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PointReader:
        return PointReader(self.options, schema.names)


@dataclass
class Written(WriterCommitMessage):
    size: int


class BlockWriter(DataSourceArrowWriter):
    """Blocks of bytes at their places; the file is there as a whole or not at all."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options["size"])
        self.own = f"{self.path}.{options['run']}.tmp"
        with open(self.own, "wb") as f:
            f.truncate(self.size)

    def write(self, batches) -> Written:
        size = 0
        with open(self.own, "r+b") as f:
            for batch in batches:
                for at, block in zip(batch.column("at").to_pylist(), batch.column("block"), strict=True):
                    f.seek(at)
                    size += f.write(block.as_buffer())
            f.flush()
            os.fsync(f.fileno())
        return Written(size)

    def commit(self, messages) -> None:
        if sum(m.size for m in messages if m) != self.size:
            self.abort(messages)
            raise OSError(f"{self.path}: not all blocks were written")
        os.replace(self.own, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.own):
            os.remove(self.own)


class BlockSink(DataSource):
    """Options: path, size (bytes of the file), run (a name of its own for each write). Rows: at, block."""

    @classmethod
    def name(cls) -> str:
        return "talus_blocks"

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options)
