"""Operators that look at a pixel's surroundings: boundaries, depth edges, hole filling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rasterloom.operators import dense, runs
from rasterloom.operators.joins import lookup_join
from rasterloom.operators.tiles import TILE, TILE_KEY, own_tile, shift_rows, to_tiles


def boundary_width(height: Column, width: Column, ratio: float = 0.02) -> Column:
    """Boundary thickness in pixels: the rounded share of the diagonal, at least 1."""
    diagonal = F.sqrt(height.cast("double") * height + width.cast("double") * width)
    return F.greatest(F.bround(F.lit(float(ratio)) * diagonal), F.lit(1.0)).cast("int")


def with_boundary_width(pixels: DataFrame, dims: DataFrame, ratio: float = 0.02) -> DataFrame:
    """Attach the boundary thickness ``_d`` of the row's image."""
    sized = dims.select("image", boundary_width(F.col("height"), F.col("width"), ratio).alias("_d"))
    return lookup_join(pixels, sized, ["image"])


def mark_boundary(pixels: DataFrame, same: Sequence[str] = ("label",), tile: int = TILE) -> DataFrame:
    """Flag pixels of each mask that an erosion by ``_d`` (square, zero outside) removes.

    A mask is the set of pixels of an image with equal ``same`` columns; masks may
    overlap. Masks travel as runs; a tile erodes them along x by arithmetic on runs
    and along y in the same way. Tiles grow with ``_d``. Adds ``boundary``; other
    columns beyond the key are dropped.
    """
    same = list(same)
    rows = runs.label_runs(pixels, same, ["_d"], by_label=True)
    kinds = [pixels.schema[c] for c in ("image", *same, "y", "x")]
    schema = T.StructType([*kinds, T.StructField("boundary", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def work(table: pa.Table) -> pa.Table:
        area = runs.Tile(table, tile)
        masks = np.stack([runs.codes_of(table.column(c))[0] for c in same], axis=1)
        _, first, code = np.unique(masks, axis=0, return_index=True, return_inverse=True)
        code = code.reshape(-1)
        everything = dense.paint(area.y, area.x0, area.x1, code, area.window)
        widths = np.minimum(area.x1, area.window[1] + area.window[3] - 1) - np.maximum(area.x0, area.window[1]) + 1
        in_lines = (area.y >= area.window[0]) & (area.y < area.window[0] + area.window[2])
        apart = int(np.maximum(widths, 0)[in_lines].sum()) == int((everything >= 0).sum())
        found = []
        # masks that don't overlap are eroded together; a label ends where another begins
        for one in [None] if apart else range(len(first)):
            pick = slice(None) if one is None else code == one
            painted = everything if apart else dense.paint(
                area.y[pick], area.x0[pick], area.x1[pick], code[pick], area.window
            )
            edge = ~dense.interior(painted, area.reach)
            y, x = area.cells(painted >= 0)
            at = (y - area.window[0], x - area.window[1])
            found.append((y, x, first[painted[at]], edge[at]))
        y, x, row, edge = (np.concatenate(c) for c in zip(*found))
        whole = [table.column(c).take(pa.array(row)) for c in ("image", *same)]
        columns = [*whole, pa.array(y), pa.array(x), pa.array(edge)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return runs.by_tile(rows, work, schema, tile)


def pixel_outcomes(aligned: DataFrame, preds: Sequence[str] = ("pred",), tile: int = TILE) -> DataFrame:
    """How often each (truth, prediction, on truth boundary, on prediction boundary) occurs.

    ``aligned`` has image, y, x, gt, ``_d`` and one label column per prediction;
    only pixels with a truth label count. ``pred_no`` is the prediction's place in
    ``preds``. Layers travel together, as runs in which no label changes; a tile
    erodes each layer once and returns counts, so neither pixels nor flags are
    shuffled. The result is a handful of rows per image from which both the region
    and the boundary scores follow.
    """
    layers = ["gt", *preds]
    rows = runs.label_runs(aligned.filter(F.col("gt").isNotNull()), layers, ["_d"])
    image, truth, pred = (aligned.schema[c].dataType for c in ("image", "gt", preds[0]))
    schema = (
        T.StructType()
        .add("image", image)
        .add("gt", truth)
        .add("gt_boundary", T.BooleanType())
        .add("pred_no", T.IntegerType())
        .add("pred", pred)
        .add("pred_boundary", T.BooleanType())
        .add("n", T.LongType())
    )
    arrow = to_arrow_schema(schema)

    def work(table: pa.Table) -> pa.Table:
        area = runs.Tile(table, tile)
        codes, edges, values = [], [], []
        for layer in layers:
            code, names = runs.codes_of(table.column(layer))
            painted = dense.paint(area.y, area.x0, area.x1, code, area.window)
            edges.append(((painted >= 0) & ~dense.interior(painted, area.reach))[area.own].ravel())
            codes.append(painted[area.own].ravel())
            values.append(names)
        scored = codes[0] >= 0
        parts = []
        for no, (code, edge, names) in enumerate(zip(codes[1:], edges[1:], values[1:])):
            n = len(names) + 1
            packed = ((codes[0] * 2 + edges[0]) * n + code + 1) * 2 + edge
            outcome, count = np.unique(packed[scored], return_counts=True)
            which = outcome // 2 % n - 1
            truth_at = outcome // 2 // n
            columns = [
                pa.array([table.column("image")[0].as_py()] * len(count), arrow.field("image").type),
                values[0].take(pa.array(truth_at // 2)).cast(arrow.field("gt").type),
                pa.array(truth_at % 2 == 1),
                pa.array(np.full(len(count), no, np.int32)),
                names.take(pa.array(which, mask=which < 0)).cast(arrow.field("pred").type),
                pa.array(outcome % 2 == 1),
                pa.array(count.astype(np.int64)),
            ]
            parts.append(pa.Table.from_arrays(columns, schema=arrow))
        return pa.concat_tables(parts)

    counts = runs.by_tile(rows, work, schema, tile)
    return counts.groupBy(*[c for c in counts.columns if c != "n"]).agg(F.sum("n").alias("n"))


def flag_depth_edges(
    pixels: DataFrame, dims: DataFrame, threshold: float = 0.1, tile: int = TILE
) -> DataFrame:
    """Add ``edge``: the pixel is on, or next to, a depth discontinuity.

    A discontinuity is a Sobel gradient above ``threshold`` times the largest
    depth within 5x5. It needs all nine pixels covered; beyond the image counts
    as depth 0. Edges spread to the four direct neighbours.
    """
    sized = lookup_join(pixels, dims.select("image", "height", "width"), ["image"])
    # Along x every pixel tells its neighbours what it adds: to the difference, the
    # smoothed value and the count of the three around, and to the largest of five.
    beside = [(0, -dx, dx, int(abs(dx) <= 1), int(dx == 0)) for dx in range(-2, 3)]
    spread = shift_rows(to_tiles(sized, 3, tile), beside, ("_away", "_near", "_self"))
    depth, near, at_self = F.col("depth").cast("double"), F.col("_near"), F.col("_self") == 1
    lines = spread.groupBy(*TILE_KEY, "y", "x").agg(
        F.sum(near * F.col("_away") * depth).alias("_diff"),
        F.sum(near * (F.lit(2) - F.abs("_away")) * depth).alias("_smooth"),
        F.sum("_near").alias("_count"),
        F.max(depth).alias("_top"),
        F.first("height").alias("height"),
        F.first("width").alias("width"),
        F.max(F.when(at_self, F.col("label"))).alias("label"),
        F.max(F.when(at_self, F.col("depth"))).alias("depth"),
    )
    # Along y the rows are summed in the same way. A missing row has nothing to add.
    column = Window.partitionBy(*TILE_KEY, "x").orderBy("y")
    three = column.rangeBetween(-1, 1)
    centers = lines.withColumns(
        {
            "gx": F.sum("_diff").over(three) + F.col("_diff"),
            "gy": F.coalesce(F.sum("_smooth").over(column.rangeBetween(1, 1)), F.lit(0.0))
            - F.coalesce(F.sum("_smooth").over(column.rangeBetween(-1, -1)), F.lit(0.0)),
            "covered": F.sum("_count").over(three),
            "top": F.max("_top").over(column.rangeBetween(-2, 2)),
        }
    ).filter(F.col("label").isNotNull() | F.col("depth").isNotNull())

    def span(axis: str, size: str) -> Column:
        return F.least(F.col(axis) + 1, F.col(size) - 1) - F.greatest(F.col(axis) - 1, F.lit(0)) + 1

    steep = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) / F.when(
        F.col("top") > 0, F.col("top")
    ).otherwise(1.0) > F.lit(float(threshold))
    edge = (F.col("covered") == span("y", "height") * span("x", "width")) & steep
    centers = centers.withColumn("_edge", edge)
    cross = [(0, 0, 1), (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0)]
    grown = shift_rows(centers, cross, ("_own",), when=F.col("_edge"))
    at_own = F.col("_own") == 1
    return (
        grown.filter(own_tile(tile))
        .groupBy(*TILE_KEY, "y", "x")
        .agg(
            F.max(F.when(at_own, F.col("label"))).alias("label"),
            F.max(F.when(at_own, F.col("depth"))).alias("depth"),
            F.max("_edge").alias("edge"),
            F.max("_own").alias("_own"),
        )
        .filter(F.col("_own") == 1)
        .select("image", "y", "x", "label", "depth", "edge")
    )


def fill_nearest(
    pixels: DataFrame, dims: DataFrame, radius: int = 5, source: Column | None = None, tile: int = TILE
) -> DataFrame:
    """Give uncovered pixels the label of the nearest covered pixel within ``radius``.

    ``source`` restricts which covered pixels may lend their label. Covered pixels
    keep theirs. Among equally near sources the uppermost lends, then the left one.
    Each tile, with a halo of ``radius``, is filled by an exact distance transform
    whose work does not grow with the radius; tiles are at least twice as large as
    their halo, so a pixel has at most four copies. Adds ``filled``.
    """
    sized = lookup_join(pixels, dims.select("image", "height", "width"), ["image"])
    lends = F.lit(True) if source is None else F.coalesce(source, F.lit(False))
    sized = sized.filter(F.col("label").isNotNull()).select(
        "image", "y", "x", "label", lends.alias("_source"), "height", "width"
    )
    tile = max(tile, 2 * radius)
    kinds = [pixels.schema[c] for c in ("image", "y", "x", "label")]
    schema = T.StructType([*kinds, T.StructField("filled", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def work(table: pa.Table) -> pa.Table:
        height, width, ty, tx = (int(table.column(c)[0].as_py()) for c in ("height", "width", "_ty", "_tx"))
        top, left = max(ty * tile - radius, 0), max(tx * tile - radius, 0)
        shape = (min((ty + 1) * tile + radius, height) - top, min((tx + 1) * tile + radius, width) - left)
        if min(shape) <= 0:
            return arrow.empty_table()
        table = table.sort_by("label")  # of several labels of one pixel the largest is painted last
        code, names = runs.codes_of(table.column("label"))
        y, x = (table.column(c).to_numpy().astype(np.int64) - start for c, start in (("y", top), ("x", left)))
        inside = (y >= 0) & (y < shape[0]) & (x >= 0) & (x < shape[1])
        y, x, code = y[inside], x[inside], code[inside]
        covered, source_at = np.full(shape, -1, np.int64), np.zeros(shape, bool)
        covered[y, x] = code
        lending = table.column("_source").to_numpy()[inside]
        source_at[y[lending], x[lending]] = True
        own = (slice(ty * tile - top, (ty + 1) * tile - top), slice(tx * tile - left, (tx + 1) * tile - left))
        line, column, away = dense.nearest_source(source_at, radius)
        empty = covered < 0
        label = np.where(empty & (away < dense.FAR), covered[line, column], covered)[own]
        y, x = np.nonzero(label >= 0)
        columns = [
            pa.array([table.column("image")[0].as_py()] * len(y), arrow.field("image").type),
            pa.array(y + own[0].start + top),
            pa.array(x + own[1].start + left),
            names.take(pa.array(label[y, x])),
            pa.array(empty[own][y, x]),
        ]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return to_tiles(sized, radius, tile).groupBy(*TILE_KEY).applyInArrow(work, schema)


def fill_edge_aware(
    pixels: DataFrame, dims: DataFrame, radius: int = 5, threshold: float = 0.1, tile: int = TILE
) -> DataFrame:
    """Nearest filling whose sources keep away from depth discontinuities."""
    flagged = flag_depth_edges(pixels, dims, threshold, tile)
    return fill_nearest(flagged, dims, radius, ~F.col("edge"), tile)


def fill_holes(
    pixels: DataFrame, dims: DataFrame, method: str = "none", radius: int = 10, threshold: float = 0.05
) -> DataFrame:
    """Fill by named method; ``none`` returns the covered pixels unchanged."""
    if method == "nearest":
        return fill_nearest(pixels, dims, radius)
    if method == "edge_aware":
        return fill_edge_aware(pixels, dims, radius, threshold)
    if method == "none":
        return pixels.select("image", "y", "x", "label", F.lit(False).alias("filled"))
    raise ValueError(f"unknown fill method {method!r}")
