"""Arrays of images as ``.npy`` files: lines filled by index, blocks of rows written by tasks.

An image no taller than a block is one file, ``<image>.npy``. A taller one is
``<image>.rows-<first row>.npy`` per block, so no task holds more than a block and a
third of all pixels in one image is still many tasks' work. Readers put blocks together.
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter

from rasterloom.operators.joins import lookup_join
from rasterloom.sinks import manifest
from rasterloom.sources.records import open_filesystem

BLOCK_ROWS = 2048
_KINDS = {"int": "<i4", "bigint": "<i8", "smallint": "<i2", "float": "<f4", "double": "<f8"}


class NpyWriter(DataSourceArrowWriter):
    """Rows (image, height, width, block, y, x, value) sorted by image and block; y is null in a block's first row."""

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        self.folder = options["path"]
        self.block_rows = int(options.get("blockrows", BLOCK_ROWS))
        self.empty = float(options.get("empty", -1))
        self.overwrite = overwrite
        self.run = uuid.uuid4().hex
        kind = schema["value"].dataType
        self.vectors = isinstance(kind, T.ArrayType)
        name = (kind.elementType if self.vectors else kind).simpleString()
        if name not in _KINDS:
            raise ValueError(f"values of type {name} have no array form")
        self.kind = np.dtype(_KINDS[name])

    def _save(self, fs, folder: str, head: dict, lines: np.ndarray) -> None:
        name = head["image"]
        if head["height"] > self.block_rows:
            name += f".rows-{head['block'] * self.block_rows:09d}"
        out = io.BytesIO()
        np.save(out, lines)
        with fs.open_output_stream(posixpath.join(folder, f"{name}.npy")) as stream:
            stream.write(out.getbuffer())

    def write(self, iterator: Iterator[pa.RecordBatch]) -> manifest.TaskFolder:
        fs, root = open_filesystem(self.folder)
        target = manifest.task_folder(self.run)
        folder = posixpath.join(root, target)
        fs.create_dir(folder, recursive=True)
        head, lines, files = None, None, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            y = batch.column("y")
            starts = [*np.flatnonzero(y.is_null().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]
            if head is not None:
                self._fill(head, lines, batch.slice(0, starts[0]))
            for start, end in zip(starts, starts[1:]):
                if head is not None:
                    self._save(fs, folder, head, lines)
                head = {c: batch.column(c)[start].as_py() for c in ("image", "height", "width", "block", "channels")}
                if "/" in head["image"]:
                    raise ValueError(f"an image's file cannot be named {head['image']!r}")
                height = min(self.block_rows, head["height"] - head["block"] * self.block_rows)
                shape = (height, head["width"], head["channels"]) if self.vectors else (height, head["width"])
                lines = np.full(shape, self.empty, self.kind)
                files += 1
                self._fill(head, lines, batch.slice(start + 1, end - start - 1))
        if head is not None:
            self._save(fs, folder, head, lines)
        return manifest.TaskFolder(target, files)

    def _fill(self, head: dict, lines: np.ndarray, pixels: pa.RecordBatch) -> None:
        if not pixels.num_rows:
            return
        y, x = (pixels.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "x"))
        value = pixels.column("value")
        if self.vectors:
            lengths = value.value_lengths().to_numpy(zero_copy_only=False)
            if not (lengths == head["channels"]).all():
                raise ValueError(f"{head['image']} holds vectors that are not {head['channels']} wide")
            value = value.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        else:
            value = value.to_numpy(zero_copy_only=False)
        lines[y - head["block"] * self.block_rows, x] = value

    def commit(self, messages) -> None:
        fs, folder = open_filesystem(self.folder)
        manifest.commit(fs, folder, self.run, messages, self.overwrite, ".npy")

    def abort(self, messages) -> None:
        fs, folder = open_filesystem(self.folder)
        manifest.abort(fs, folder, self.run)


def write_rasters(
    pixels: DataFrame,
    dims: DataFrame,
    folder: str,
    value: str = "label",
    empty: float = -1,
    channels: int = 1,
    block_rows: int = BLOCK_ROWS,
    mode: str = "overwrite",
) -> None:
    """Array files of all images in ``dims``, ``empty`` where an image has no pixel.

    ``value`` is a number per pixel, or an array of ``channels`` numbers. Pixels outside
    their image, or without a value, are left out.
    """
    sized = dims.select(F.col("image").cast("string").alias("image"), "height", "width")
    last = F.floor((F.greatest(F.col("height"), F.lit(1)) - 1) / F.lit(block_rows)).cast("int")
    blocks = sized.withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    placed = pixels.select(F.col("image").cast("string").alias("image"), "y", "x", F.col(value).alias("value"))
    placed = lookup_join(placed, sized, ["image"])
    placed = placed.filter(
        F.col("value").isNotNull() & F.col("y").between(0, F.col("height") - 1) & F.col("x").between(0, F.col("width") - 1)
    ).withColumn("block", F.floor(F.col("y") / F.lit(block_rows)).cast("int"))
    both = blocks.unionByName(placed, allowMissingColumns=True).withColumn("channels", F.lit(int(channels)))
    both = both.repartition("image", "block").sortWithinPartitions("image", "block", F.col("y").asc_nulls_first())
    writer = both.write.format("npy").mode(mode).option("empty", empty).option("blockrows", block_rows)
    writer.save(folder)
