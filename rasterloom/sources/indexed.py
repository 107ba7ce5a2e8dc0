"""Files of variable-length records, read in two passes.

A record's length stands inside it, so borders can only be found from the start of
a file. A first pass, one task a file, hops from record to record, reads only what
holds a length, and lists a byte range every so many records or bytes. The second
pass reads ranges, each a task's work of its own, and decodes them as arrays.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rasterloom.session import cut_lineage
from rasterloom.sources.records import open_filesystem

RANGE_RECORDS = 50_000
RANGE_BYTES = 16 << 20
# What the first pass reads at once; a gap larger than this is skipped by a seek.
_WINDOW = 4 << 20
_HEAD = 8  # the record count in front
_INDEX = "path string, first long, n long, low long, high long"

# Length of the record at a place of a block; None when the block ends before the length does.
Length = Callable[[bytes, int], int | None]


def _open(path: str):
    if path.startswith("file:"):  # Spark's names are not escaped, as a URI would be
        path = path[5:] if not path.startswith("file://") else path[7:]
    fs, inner = open_filesystem(path)
    return fs.open_input_file(inner)


def record_starts(file, count: int, length: Length, window: int = _WINDOW) -> Iterator[tuple[int, int]]:
    """(start, end) of every record of an open file."""
    at, base, block, want = _HEAD, _HEAD, b"", window
    for _ in range(count):
        while True:
            size = length(block, at - base) if at - base < len(block) else None
            if size is not None:
                break
            file.seek(at)
            longer = file.read(want)
            if base == at and len(longer) == len(block):
                raise OSError("the file is shorter than its header says")
            base, block = at, longer
            want *= 2  # a record whose length lies beyond the window
        want = window
        yield at, at + size
        at += size


def file_ranges(
    file, length: Length, every: int = RANGE_RECORDS, most: int = RANGE_BYTES, window: int = _WINDOW
) -> Iterator[tuple[int, int, int, int]]:
    """(first record, records, low, high) of ranges of at most ``every`` records and about ``most`` bytes."""
    file.seek(0)
    count = struct.unpack("<Q", file.read(_HEAD))[0]
    first, n, low, end = 0, 0, _HEAD, _HEAD
    for start, end in record_starts(file, count, length, window):
        if n and (n == every or end - low > most):
            yield first, n, low, start
            first, n, low = first + n, 0, start
        n += 1
    file.seek(0, 2)
    if end > file.tell():
        raise OSError("the file is shorter than its header says")
    if n:
        yield first, n, low, end


def index_files(
    spark: SparkSession, path: str, length: Length, every: int = RANGE_RECORDS, most: int = RANGE_BYTES
) -> DataFrame:
    """The ranges of all files at ``path`` (a file, folder or glob); files are listed without their content."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                out: list[list] = [[], [], [], [], []]
                with _open(name) as file:
                    for found in file_ranges(file, length, every, most):
                        for column, value in zip(out, (name, *found)):
                            column.append(value)
                yield pa.RecordBatch.from_pydict(dict(zip(("path", "first", "n", "low", "high"), out)), schema=arrow)

    arrow = to_arrow_schema(T.StructType.fromDDL(_INDEX))
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition("path").mapInArrow(listed, _INDEX)


def read_ranges(
    index: DataFrame, length: Length, decode: Callable[[bytes, np.ndarray], pa.RecordBatch], schema: str
) -> DataFrame:
    """``decode(bytes of a range, places of its records)`` for every range, with the file's ``path``.

    The index is stored, so ranges are dealt to as many tasks as there are ranges and cores for.
    """
    kept = cut_lineage(index)
    parallel = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(kept.count(), 4 * parallel))
    whole = T.StructType([T.StructField("path", T.StringType()), *T.StructType.fromDDL(schema)])
    arrow = to_arrow_schema(whole)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as file:
                    file.seek(row["low"])
                    data = file.read(row["high"] - row["low"])
                if len(data) < row["high"] - row["low"]:
                    raise OSError(f"{row['path']} changed while it was read")
                starts, at = np.empty(row["n"], np.int64), 0
                for i in range(row["n"]):
                    starts[i] = at
                    at += length(data, at)
                made = decode(data, starts)
                columns = [pa.array([row["path"]] * made.num_rows, pa.string()), *made.columns]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return kept.repartition(tasks, "path", "low").mapInArrow(read, whole)


def fields_at(data: bytes, starts: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """The fixed fields of records that begin at ``starts``, as one structured array."""
    raw = np.frombuffer(data, np.uint8)
    return np.ascontiguousarray(raw[starts[:, None] + np.arange(dtype.itemsize)]).view(dtype).reshape(-1)


def lists_of(data: bytes, starts: np.ndarray, counts: np.ndarray, dtype: np.dtype) -> pa.ListArray:
    """Per record the array of ``counts`` structs that begins at ``starts``, without a loop over structs."""
    raw = np.frombuffer(data, np.uint8)
    sizes = counts * dtype.itemsize
    ends = np.cumsum(sizes)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    rows = np.ascontiguousarray(raw[place + np.repeat(starts, sizes)]).view(dtype)
    values = pa.StructArray.from_arrays([pa.array(rows[n]) for n in dtype.names], names=list(dtype.names))
    offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)
