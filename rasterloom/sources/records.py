"""Spark data sources for files of fixed-length records: ``las`` and ``ply`` points, ``npy`` array lines.

A large file is cut into byte ranges, one task each; small files share a task. A task
reads a file's header and then the records that start inside its range, so record numbers
(``point_idx``) come for free and no other part of the file is touched.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rasterloom.sinks.manifest import counted

SPLIT_BYTES = 64 << 20
_BATCH_BYTES = 4 << 20
# Small files that one task reads at most.
_OPENED = 256


def open_filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a local path or a URI."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), posixpath.abspath(path)


def list_files(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of a file, a folder's files or a glob's matches, sorted by path.

    Of a folder that a sink publishes by manifests, the files that the newest one names.
    """
    fs, inner = open_filesystem(path)
    if any(ch in inner for ch in "*?["):
        parent, pattern = posixpath.dirname(inner), posixpath.basename(inner)
        infos = [i for i in fs.get_file_info(pafs.FileSelector(parent)) if fnmatch.fnmatch(i.base_name, pattern)]
    else:
        info = fs.get_file_info(inner)
        if info.type == pafs.FileType.Directory:
            infos = counted(fs, fs.get_file_info(pafs.FileSelector(inner, recursive=True)))
        else:
            infos = [info] if info.type == pafs.FileType.File else []
    found = sorted(
        (i.path, i.size)
        for i in infos
        if i.type == pafs.FileType.File and i.base_name.lower().endswith(suffixes) and not i.base_name.startswith((".", "_"))
    )
    if not found:
        raise FileNotFoundError(f"no {' or '.join(suffixes)} files at {path}")
    return found


def inner_names(root: str, paths: Sequence[str]) -> list[str]:
    """Files' paths below the folder that was loaded, which tell files of one name apart."""
    fs, inner = open_filesystem(root)
    if any(ch in inner for ch in "*?[") or fs.get_file_info(inner).type != pafs.FileType.Directory:
        return [posixpath.basename(p) for p in paths]
    return [posixpath.relpath(p, inner) for p in paths]


@dataclass
class Layout:
    """Where a file's records are and how one looks."""

    start: int
    count: int
    dtype: np.dtype
    extra: dict


@dataclass
class ByteRange:
    path: str
    low: int
    high: int
    name: str


@dataclass
class Ranges(InputPartition):
    """What one task reads: a range of a large file, or many small files."""

    ranges: list[ByteRange]


def dealt(ranges: Iterable[ByteRange], split: int) -> list[Ranges]:
    """Ranges in their order, together until they hold ``split`` bytes; opening a file counts as a share of them."""
    out: list[Ranges] = []
    size = split
    for part in ranges:
        cost = part.high - part.low + split // _OPENED
        if size + cost > split:
            out.append(Ranges([]))
            size = 0
        out[-1].ranges.append(part)
        size += cost
    return out


class RecordReader(DataSourceReader):
    suffixes: tuple[str, ...] = ()

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema = schema
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Ranges]:
        files = list_files(self.path, self.suffixes)
        ranges = []
        for (path, size), name in zip(files, inner_names(self.path, [p for p, _ in files])):
            ranges += [ByteRange(path, low, min(low + self.split, size), name) for low in range(0, size, self.split)]
        return dealt(ranges, self.split)

    def layout(self, head) -> Layout:
        raise NotImplementedError

    def columns(self, block: np.ndarray, layout: Layout) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = open_filesystem(self.path)
        target = pa.schema([pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in self.schema.fields])
        for part in partition.ranges:
            yield from self._records(fs, part, target)

    def _records(self, fs: pafs.FileSystem, partition: ByteRange, target: pa.Schema) -> Iterator[pa.RecordBatch]:
        with fs.open_input_file(partition.path) as file:
            layout = self.layout(file)
            width = layout.dtype.itemsize

            def first_at(offset: int) -> int:
                return min(layout.count, max(0, -(-(offset - layout.start) // width)))

            index, end = first_at(partition.low), first_at(partition.high)
            step = max(1, _BATCH_BYTES // width)
            name = partition.name
            while index < end:
                n = min(step, end - index)
                file.seek(layout.start + index * width)
                block = np.frombuffer(file.read(n * width), dtype=layout.dtype)
                if len(block) < n:
                    raise OSError(f"{partition.path} is shorter than its header says")
                values = self.columns(block, layout)
                values["src_file"] = np.full(n, name, dtype=object)
                values["point_idx"] = np.arange(index, index + n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[f.name], type=f.type) for f in target], schema=target
                )
                index += n


_ARROW = {
    "string": pa.string(),
    "bigint": pa.int64(),
    "int": pa.int32(),
    "smallint": pa.int16(),
    "double": pa.float64(),
    "float": pa.float32(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
}

# --- LAS --------------------------------------------------------------------------

LAS_SCHEMA = "src_file string, point_idx bigint, x double, y double, z double, class smallint"


class LasReader(RecordReader):
    suffixes = (".las",)

    def layout(self, file) -> Layout:
        """Fields of the public header block, at the offsets the LAS format fixes."""
        file.seek(0)
        head = file.read(375)
        if head[:4] != b"LASF":
            raise ValueError("not a LAS file")
        minor = head[25]
        start, kind, width, legacy = struct.unpack_from("<I", head, 96)[0], head[104], *struct.unpack_from("<HI", head, 105)
        if kind & 0xC0:
            raise ValueError("compressed LAS is not read here; decompress it first")
        count = struct.unpack_from("<Q", head, 247)[0] if minor >= 4 else legacy
        at = 15 if kind < 6 else 16
        dtype = np.dtype(
            {"names": ["X", "Y", "Z", "c"], "formats": ["<i4", "<i4", "<i4", "u1"], "offsets": [0, 4, 8, at], "itemsize": width}
        )
        scale = struct.unpack_from("<3d", head, 131)
        offset = struct.unpack_from("<3d", head, 155)
        return Layout(start, count, dtype, {"scale": scale, "offset": offset, "mask": 0x1F if kind < 6 else 0xFF})

    def columns(self, block: np.ndarray, layout: Layout) -> dict[str, np.ndarray]:
        scale, offset = layout.extra["scale"], layout.extra["offset"]
        out = {a: block[a.upper()] * scale[i] + offset[i] for i, a in enumerate("xyz")}
        out["class"] = (block["c"] & layout.extra["mask"]).astype(np.int16)
        return out


class LasSource(DataSource):
    """``spark.read.format("las").load(path)``: x, y, z and class of uncompressed LAS files."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return LAS_SCHEMA

    def reader(self, schema: T.StructType) -> LasReader:
        return LasReader(schema, self.options)


# --- PLY --------------------------------------------------------------------------

# Scalar types of the PLY format, with the Spark type that holds them.
PLY_TYPES = {
    "char": ("i1", "smallint"),
    "int8": ("i1", "smallint"),
    "uchar": ("u1", "smallint"),
    "uint8": ("u1", "smallint"),
    "short": ("i2", "smallint"),
    "int16": ("i2", "smallint"),
    "ushort": ("u2", "int"),
    "uint16": ("u2", "int"),
    "int": ("i4", "int"),
    "int32": ("i4", "int"),
    "uint": ("u4", "bigint"),
    "uint32": ("u4", "bigint"),
    "float": ("f4", "float"),
    "float32": ("f4", "float"),
    "double": ("f8", "double"),
    "float64": ("f8", "double"),
}


def ply_header(file) -> tuple[int, str, int, list[tuple[str, str]]]:
    """Data offset, format, vertex count and (name, type) of the vertex properties."""
    file.seek(0)
    head = b""
    while b"end_header" not in head or not head.split(b"end_header", 1)[1].startswith((b"\n", b"\r\n")):
        more = file.read(4096)
        if not more or not head.startswith(b"ply"[: len(head)]):
            raise ValueError("not a PLY file")
        head += more
    text, rest = head.split(b"end_header", 1)
    start = len(text) + len(b"end_header") + (2 if rest.startswith(b"\r\n") else 1)
    kind, count, element, properties = "", 0, None, []
    for line in text.decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            if element is None and words[1] != "vertex":
                raise ValueError("the vertex element must come first")
            element = words[1]
            count = int(words[2]) if element == "vertex" else count
        elif words[:1] == ["property"] and element == "vertex":
            if words[1] == "list":
                raise ValueError("list properties of vertices are not supported")
            properties.append((words[2], words[1]))
    return start, kind, count, properties


class PlyReader(RecordReader):
    suffixes = (".ply",)

    def layout(self, file) -> Layout:
        start, kind, count, properties = ply_header(file)
        order = {"binary_little_endian": "<", "binary_big_endian": ">"}.get(kind)
        if order is None:
            raise ValueError(f"PLY format {kind!r} is not read here; only binary files can be split")
        wanted = [f.name for f in self.schema.fields if f.name not in ("src_file", "point_idx")]
        found = [n for n, _ in properties]
        if not set(wanted) <= set(found):
            raise ValueError(f"a PLY file has the fields {found}, but the table needs {wanted}")
        return Layout(start, count, np.dtype([(n, order + PLY_TYPES[t][0]) for n, t in properties]), {})

    def columns(self, block: np.ndarray, layout: Layout) -> dict[str, np.ndarray]:
        wanted = {f.name for f in self.schema.fields}
        return {n: block[n].astype(block[n].dtype.newbyteorder("=")) for n in block.dtype.names if n in wanted}


class PlySource(DataSource):
    """``spark.read.format("ply").load(path)``: all vertex properties of binary PLY files.

    The columns come from the first file's header. A schema passed by the caller
    limits what is decoded.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        path = list_files(self.options["path"], PlyReader.suffixes)[0][0]
        fs, _ = open_filesystem(self.options["path"])
        with fs.open_input_file(path) as file:
            properties = ply_header(file)[3]
        columns = ", ".join(f"`{n}` {PLY_TYPES[t][1]}" for n, t in properties)
        return f"src_file string, point_idx bigint, {columns}"

    def reader(self, schema: T.StructType) -> PlyReader:
        return PlyReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool):
        from rasterloom.sinks.ply import PlyWriter

        return PlyWriter(schema, self.options, overwrite)


# --- arrays -----------------------------------------------------------------------

NPY_SCHEMA = "src_file string, point_idx bigint, shape array<int>, kind string, line binary"


def npy_header(file) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, item type and data offset of an array file; nothing past the header is read."""
    file.seek(0)
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = read(file)
    if by_column or dtype.hasobject:
        raise ValueError("only plain arrays stored row by row are read")
    return shape, dtype, file.tell()


class NpyReader(RecordReader):
    """One record is one line: the values of the last ``axes`` axes (option, 1 by default)."""

    suffixes = (".npy",)

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        super().__init__(schema, options)
        self.axes = int(options.get("axes", 1))
        self.suffixes = (options.get("ending", ".npy").lower(),)

    def layout(self, file) -> Layout:
        shape, dtype, start = npy_header(file)
        if len(shape) < self.axes:
            raise ValueError(f"an array of shape {shape} has no lines of {self.axes} axes")
        width = int(np.prod(shape[len(shape) - self.axes :])) * dtype.itemsize
        count = int(np.prod(shape[: len(shape) - self.axes])) if width else 0
        return Layout(start, count, np.dtype((np.void, max(width, 1))), {"shape": list(shape), "kind": dtype.str})

    def columns(self, block: np.ndarray, layout: Layout) -> dict[str, np.ndarray]:
        n = len(block)
        return {"shape": [layout.extra["shape"]] * n, "kind": [layout.extra["kind"]] * n, "line": block.tolist()}


class NpySource(DataSource):
    """``spark.read.format("npy").load(path)``: the lines of array files, large files in several tasks."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return NPY_SCHEMA

    def reader(self, schema: T.StructType) -> NpyReader:
        return NpyReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool):
        from rasterloom.sinks.npy import NpyWriter

        return NpyWriter(schema, self.options, overwrite)


def read_shapes(spark: SparkSession, path: str, ending: str = ".npy"):
    """(path, shape) of every array file, from the headers alone."""
    files = [(p,) for p, _ in list_files(path, (ending.lower(),))]

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_filesystem(path)
        for batch in batches:
            found = []
            for name in batch.column("path").to_pylist():
                with fs.open_input_file(name) as file:
                    found.append(list(npy_header(file)[0]))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.list_(pa.int32()))], ["path", "shape"])

    return spark.createDataFrame(files, "path string").mapInArrow(shapes, "path string, shape array<int>")


def count_records(spark: SparkSession, path: str, kind: str) -> int:
    """Sum of the record counts that the files' headers state; one task row per file, no record is read."""
    source = {"las": LasReader, "ply": PlyReader}[kind]
    fields = T.StructType()
    files = [(p,) for p, _ in list_files(path, source.suffixes)]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, (fs, _) = source(fields, {"path": path}), open_filesystem(path)
        for batch in batches:
            found = []
            for name in batch.column("path").to_pylist():
                with fs.open_input_file(name) as file:
                    found.append(reader.layout(file).count)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["n"])

    rows = spark.createDataFrame(files, "path string").mapInArrow(counts, "n long")
    return rows.agg({"n": "sum"}).first()[0] or 0


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (LasSource, PlySource, NpySource):
        spark.dataSource.register(source)
