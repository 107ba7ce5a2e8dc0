"""Nearest hit per pixel: hits are reduced by packed 64-bit keys before and after one shuffle by tile.

Each task keeps one candidate per pixel of what it holds, so what is shuffled
follows pixels and tasks and not hits, and no aggregation sorts or hashes structs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rasterloom.operators.tiles import TILE

# Hits gathered before they are reduced; reduced ones beyond half of this go on to the shuffle.
GATHERED = 1 << 20
_COLUMNS = ("image", "y", "x", "depth", "label", "src_file", "point_idx")


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Places of the values among the column's sorted distinct values; null comes first, as -1."""
    encoded = column.combine_chunks().dictionary_encode()
    rank = np.empty(len(encoded.dictionary) + 1, np.int64)
    rank[np.asarray(pc.sort_indices(encoded.dictionary))] = np.arange(len(encoded.dictionary))
    rank[-1] = -1
    return rank[encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)]


def _depth_bits(depth: np.ndarray) -> np.ndarray:
    """Single-precision depths as integers of the same order."""
    bits = (depth.astype(np.float32) + np.float32(0.0)).view(np.int32).astype(np.int64)
    return np.where(bits < 0, bits ^ 0x7FFFFFFF, bits)


def nearest_hits(hits: pa.Table) -> pa.Table:
    """One hit per pixel: the smallest depth, then the first by file and point number.

    A key holds the depth's 32 bits above the hit's place in file order.
    """
    n = hits.num_rows
    point = hits.column("point_idx").fill_null(-1).to_numpy()
    place = np.empty(n, np.int64)
    place[np.lexsort((point, _ranks(hits.column("src_file"))))] = np.arange(n)
    key = (_depth_bits(hits.column("depth").to_numpy()) << 32) + place
    pixel = (hits.column("image"), hits.column("y"), hits.column("x"))
    ranks = [_ranks(pixel[0]), *(c.to_numpy().astype(np.int64) for c in pixel[1:])]
    order = np.lexsort((key, *reversed(ranks)))
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    for rank in ranks:
        fresh[1:] |= rank[order][1:] != rank[order][:-1]
    return hits.take(pa.array(order[fresh]))


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduces what a task holds; memory is bounded, so a pixel may leave a task more than once."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= GATHERED:
            best = nearest_hits(pa.concat_tables(held))
            if best.num_rows > GATHERED // 2:
                yield from best.to_batches()
                held = []
            else:
                held = [best]
    if held:
        yield from nearest_hits(pa.concat_tables(held)).to_batches()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduces rows sorted by tile; holds the gathered rows and one tile's pixels."""

    def tile_of(table: pa.Table, row: int) -> tuple:
        return tuple(table.column(c)[row].as_py() for c in ("image", "_ty", "_tx"))

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from nearest_hits(table).select(["image", "y", "x", "label", "depth"]).to_batches()

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < GATHERED:
            continue
        rows = pa.concat_tables(held)
        last = tile_of(rows, rows.num_rows - 1)
        low, high = 0, rows.num_rows - 1  # where the last tile begins
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if tile_of(rows, middle) == last else (middle + 1, high)
        if low:
            yield from done(rows.slice(0, low))
        held = [nearest_hits(rows.slice(low))]
    if held:
        yield from done(pa.concat_tables(held))


def nearest_per_pixel(hits: DataFrame, tile: int = TILE) -> DataFrame:
    """image, y, x, label, depth of every pixel's nearest hit (single precision), the first point on a tie."""
    rows = hits.select(*[F.col(c).cast("float").alias(c) if c == "depth" else F.col(c) for c in _COLUMNS])
    schema = rows.schema
    tiles = [F.floor(F.col(a) / F.lit(tile)).cast("int").alias(f"_t{a}") for a in "yx"]
    reduced = rows.mapInArrow(_reduce, schema).select("*", *tiles)
    sorted_rows = reduced.repartition("image", "_ty", "_tx").sortWithinPartitions("image", "_ty", "_tx")
    out = T.StructType([schema[c] for c in ("image", "y", "x", "label", "depth")])
    to_arrow_schema(out)  # unsupported label types fail here and not in a task
    return sorted_rows.mapInArrow(_finish, out)
