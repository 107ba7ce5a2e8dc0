"""PLY output: complete binary tiles written in parallel.

A PLY header states its vertex count, so each tile is held until it is full and
then written with its own header. Tiles are bounded, no count over the whole
table is needed, and the files of a folder together hold the cloud.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter

from rasterloom.sinks import manifest
from rasterloom.sources.records import open_filesystem

TILE_ROWS = 2_000_000

# Spark type to (numpy type, PLY type) of a stored property.
_STORED = {
    "float": ("<f4", "float"),
    "double": ("<f8", "double"),
    "smallint": ("<i2", "short"),
    "int": ("<i4", "int"),
    "tinyint": ("i1", "char"),
}


class PlyWriter(DataSourceArrowWriter):
    """Writes tiles below a run folder in the tasks; the commit publishes a manifest of them."""

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        self.folder = options["path"]
        self.rows = int(options.get("tilerows", TILE_ROWS))
        bytes_ = {n for n in options.get("uchar", "").split(",") if n}
        self.overwrite = overwrite
        self.run = uuid.uuid4().hex
        fields = []
        for f in schema.fields:
            kind = f.dataType.simpleString()
            if f.name in bytes_:
                fields.append((f.name, "u1", "uchar"))
            elif kind in _STORED:
                fields.append((f.name, *_STORED[kind]))
            else:
                raise ValueError(f"column {f.name} of type {kind} has no PLY form")
        self.fields = fields

    def _header(self, count: int) -> bytes:
        lines = ["ply", "format binary_little_endian 1.0", f"element vertex {count}"]
        lines += [f"property {ply} {name}" for name, _, ply in self.fields]
        return ("\n".join([*lines, "end_header"]) + "\n").encode("ascii")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> manifest.TaskFolder:
        fs, root = open_filesystem(self.folder)
        target = manifest.task_folder(self.run)
        folder = posixpath.join(root, target)
        fs.create_dir(folder, recursive=True)
        dtype = np.dtype([(n, t) for n, t, _ in self.fields])
        tiles, held, count = 0, [], 0

        def flush() -> None:
            nonlocal tiles, held, count
            if count:
                with fs.open_output_stream(posixpath.join(folder, f"tile-{tiles:06d}.ply")) as out:
                    out.write(self._header(count))
                    for block in held:
                        out.write(block.tobytes())
                tiles += 1
            held, count = [], 0

        for batch in iterator:
            block = np.empty(batch.num_rows, dtype=dtype)
            for i, (name, _, _) in enumerate(self.fields):
                block[name] = batch.column(i).to_numpy(zero_copy_only=False)
            while len(block):
                take = block[: self.rows - count]
                held.append(take)
                count += len(take)
                block = block[len(take) :]
                if count == self.rows:
                    flush()
        flush()
        return manifest.TaskFolder(target, tiles)

    def commit(self, messages: list[manifest.TaskFolder | None]) -> None:
        fs, folder = open_filesystem(self.folder)
        manifest.commit(fs, folder, self.run, messages, self.overwrite, ".ply")

    def abort(self, messages: list[manifest.TaskFolder | None]) -> None:
        fs, folder = open_filesystem(self.folder)
        manifest.abort(fs, folder, self.run)


def write_ply(df: DataFrame, folder: str, mode: str = "overwrite", uchar: tuple[str, ...] = (), tile_rows: int = TILE_ROWS) -> None:
    """Store numeric columns as PLY tiles; ``uchar`` columns take one unsigned byte."""
    df.write.format("ply").mode(mode).option("uchar", ",".join(uchar)).option("tilerows", tile_rows).save(folder)


def write_points(points: DataFrame, folder: str, mode: str = "overwrite", tile_rows: int = TILE_ROWS) -> None:
    """x, y, z in single precision and the class as one byte."""
    out = points.select(*[F.col(a).cast("float").alias(a) for a in "xyz"], F.col("class").cast("smallint"))
    write_ply(out, folder, mode, ("class",), tile_rows)


def write_colored(points: DataFrame, folder: str, mode: str = "overwrite", tile_rows: int = TILE_ROWS) -> None:
    """Positions, zero normals and byte colours; r, g, b are 0..255."""
    zero = F.lit(0.0).cast("float")
    out = points.select(
        *[F.col(a).cast("float").alias(a) for a in "xyz"],
        *[zero.alias(n) for n in ("nx", "ny", "nz")],
        *[F.col(c).cast("smallint").alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))],
    )
    write_ply(out, folder, mode, ("red", "green", "blue"), tile_rows)


def splat_columns(n_rest: int, n_scale: int = 3, n_rot: int = 4) -> list[Column]:
    """Splat attributes in storage order: position, normals, colour terms, opacity, scale, rotation."""

    def spread(source: str, n: int, prefix: str) -> list[Column]:
        return [F.element_at(source, i + 1).cast("float").alias(f"{prefix}_{i}") for i in range(n)]

    return [
        *[F.col(a).cast("float").alias(a) for a in "xyz"],
        *[F.lit(0.0).cast("float").alias(n) for n in ("nx", "ny", "nz")],
        *spread("f_dc", 3, "f_dc"),
        *spread("f_rest", n_rest, "f_rest"),
        F.col("opacity").cast("float").alias("opacity"),
        *spread("scale", n_scale, "scale"),
        *spread("rot", n_rot, "rot"),
    ]


def write_splats(splats: DataFrame, folder: str, degree: int = 3, mode: str = "overwrite", tile_rows: int = TILE_ROWS) -> None:
    """Splat table to PLY tiles; ``degree`` fixes the number of higher colour terms."""
    write_ply(splats.select(*splat_columns(3 * (degree + 1) ** 2 - 3)), folder, mode, (), tile_rows)
