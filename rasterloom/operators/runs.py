"""Runs of equal labels, the unit in which label layers travel to tiles.

A run is (image, y, x0, x1) with its labels. Runs are made where the pixels lie,
before any shuffle, so what is shuffled follows the number of runs and not of pixels.
A run cut by a batch or a partition is simply two runs: tiles paint them side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rasterloom.operators.tiles import TILE, TILE_KEY, tile_for


def codes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Small integers for the values of a column, -1 for null, and the values they stand for."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    encoded = column.dictionary_encode()
    indices = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return indices, encoded.dictionary


def label_runs(pixels: DataFrame, labels: Sequence[str], keep: Sequence[str] = (), by_label: bool = False) -> DataFrame:
    """Runs along x of pixels(image, y, x, labels, keep) whose labels are all equal.

    Pixels are sorted inside their partitions only. Partitions that hold whole lines, as
    line-wise readers and alignment by line make them, give the fewest runs.
    ``by_label`` allows several pixels in one place, one per combination of labels.
    """
    order = ["image", *(labels if by_label else ()), "y", "x"]
    rows = pixels.select("image", "y", *labels, *keep, "x").sortWithinPartitions(*order)
    fields = [f for f in rows.schema if f.name != "x"]
    schema = T.StructType([*fields, T.StructField("x0", T.IntegerType()), T.StructField("x1", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").to_numpy(zero_copy_only=False).astype(np.int32)
            joined = x[1:] == x[:-1] + 1
            for field in fields:
                codes, _ = codes_of(batch.column(field.name))
                joined &= codes[1:] == codes[:-1]
            heads = np.flatnonzero(np.append(True, ~joined))
            ends = np.append(heads[1:], len(x)) - 1
            taken = [batch.column(f.name).take(pa.array(heads)) for f in fields]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(x[heads]), pa.array(x[ends])], schema=arrow)

    return rows.mapInArrow(run, schema)


def runs_to_tiles(runs: DataFrame, halo: Column, tile: Column) -> DataFrame:
    """Copies runs into all tiles they come within ``halo`` of."""
    out = runs
    for axis, low, high in (("y", "y", "y"), ("x", "x0", "x1")):
        first = F.greatest(F.floor((F.col(low) - halo) / tile), F.lit(0)).cast("int")
        last = F.floor((F.col(high) + halo) / tile).cast("int")
        out = out.withColumn(f"_t{axis}", F.explode(F.sequence(first, last)))
    return out


class Tile:
    """One tile's runs as arrays, and the window they are painted in: the runs' bounds, cut to tile and halo."""

    def __init__(self, table: pa.Table, least: int = TILE):
        self.table = table
        self.reach = int(table.column("_d")[0].as_py())
        self.size = max(least, 2 * self.reach)
        at = [int(table.column(c)[0].as_py()) * self.size for c in ("_ty", "_tx")]
        self.y, self.x0, self.x1 = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        top, left = max(at[0] - self.reach, int(self.y.min())), max(at[1] - self.reach, int(self.x0.min()))
        bottom = min(at[0] + self.size + self.reach - 1, int(self.y.max()))
        right = min(at[1] + self.size + self.reach - 1, int(self.x1.max()))
        self.window = (top, left, bottom - top + 1, right - left + 1)
        # the tile proper, as slices of the window
        self.own = tuple(
            slice(max(a - start, 0), max(min(a + self.size - start, n), 0))
            for a, start, n in zip(at, (top, left), self.window[2:])
        )

    def cells(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Image coordinates of the marked cells of the tile proper."""
        y, x = np.nonzero(mask[self.own])
        return y + self.own[0].start + self.window[0], x + self.own[1].start + self.window[1]


def by_tile(
    runs: DataFrame, work: Callable[[pa.Table], pa.Table], schema: T.StructType, least: int = TILE
) -> DataFrame:
    """``work`` on the runs of every tile, given the reach ``_d`` of their image; one shuffle, of runs."""
    reach = F.col("_d")
    tiled = runs_to_tiles(runs, reach, tile_for(reach, least))
    return tiled.groupBy(*TILE_KEY).applyInArrow(work, schema)
