"""Algebra of sparse label rasters ``pixels(image, y, x, label)``; no row means no label."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import labels
from rasterloom.operators.joins import lookup_join

PIXEL = ("image", "y", "x")


def sparse(pixels: DataFrame, lowest_valid: int = 0) -> DataFrame:
    """Drop rows that hold a "no label" sentinel."""
    return pixels.filter(F.col("label") >= lowest_valid)


def drop_unknown(pixels: DataFrame, classes: Iterable[int] | DataFrame) -> DataFrame:
    """Keep pixels whose class is mapped; ``classes`` is a list of ids or a table."""
    if isinstance(classes, DataFrame):
        known = classes.select(F.col("class_id").alias("label")).distinct()
        return lookup_join(pixels, known, ["label"], "left_semi")
    return pixels.filter(F.col("label").isin([int(c) for c in classes]))


def align_columns(tables: Sequence[DataFrame], key: Sequence[str] = PIXEL, lines: bool = False) -> DataFrame:
    """One row per pixel with the value columns of all tables, NULL where one has no row.

    The tables are stacked and grouped once, so any number of them costs a single
    shuffle and needs no sort. Each table has at most one row per pixel, and its
    value columns (all others than the key) are its own. ``lines`` makes that one
    shuffle by (image, y), so each partition holds whole lines and gives long runs.
    """
    stacked = tables[0]
    for other in tables[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    values = [c for c in stacked.columns if c not in key]
    if lines:
        stacked = stacked.repartition("image", "y")
    return stacked.groupBy(*key).agg(*[F.max(c).alias(c) for c in values])


def align_layers(layers: Mapping[str, DataFrame], key: Sequence[str] = PIXEL, lines: bool = False) -> DataFrame:
    """One row per pixel with the label of each named layer."""
    return align_columns([df.select(*key, F.col("label").alias(name)) for name, df in layers.items()], key, lines)


def fuse_priority(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Primary label where there is one, else the secondary label."""
    both = align_layers({"primary": primary, "secondary": secondary})
    return both.select(*PIXEL, F.coalesce("primary", "secondary").alias("label"))


def shape_mismatches(dims_a: DataFrame, dims_b: DataFrame) -> DataFrame:
    """Images whose two layers differ in size; fusing needs this to be empty."""
    b = dims_b.select("image", F.col("height").alias("height_b"), F.col("width").alias("width_b"))
    return dims_a.join(b, "image").filter(
        (F.col("height") != F.col("height_b")) | (F.col("width") != F.col("width_b"))
    )


def require_same_shape(dims_a: DataFrame, dims_b: DataFrame) -> None:
    """Raises where an image's two layers differ in size; at most ten are named."""
    wrong = shape_mismatches(dims_a, dims_b).orderBy("image").limit(10).collect()
    if wrong:
        sizes = ", ".join(f"{r['image']}: {r['height']}x{r['width']} and {r['height_b']}x{r['width_b']}" for r in wrong)
        raise ValueError(f"truth layers differ in size: {sizes}")


def require_inside(pixels: DataFrame, dims: DataFrame) -> None:
    """Raises where an image has pixels outside its size, or no size; at most ten are named."""
    ends = pixels.groupBy("image").agg(F.max("y").alias("_y"), F.max("x").alias("_x"))
    sized = ends.join(dims.select("image", "height", "width"), "image", "left")
    outside = F.col("height").isNull() | (F.col("_y") >= F.col("height")) | (F.col("_x") >= F.col("width"))
    wrong = sized.filter(outside).orderBy("image").limit(10).collect()
    if wrong:
        sizes = ", ".join(f"{r['image']}: {r['_y']}, {r['_x']} in {r['height']}x{r['width']}" for r in wrong)
        raise ValueError(f"pixels lie outside their images: {sizes}")


def merge_labels(pixels: DataFrame, merge_map: Mapping[int, Sequence[int]]) -> DataFrame:
    """Ordered class merges."""
    return pixels.withColumn("label", labels.merge_sequential(F.col("label"), merge_map))


def map_labels(pixels: DataFrame, mapping: Mapping[int, int], default: int | None = 0) -> DataFrame:
    """Class ids of one vocabulary to another; unmapped ids become ``default``."""
    return pixels.withColumn("label", labels.map_ids(F.col("label"), mapping, default))


def split_layers(primary: DataFrame, secondary: DataFrame, keep_ids: Iterable[int]) -> DataFrame:
    """Kept primary, secondary fill and their fusion as three columns per pixel.

    ``secondary`` holds mapped ids. It fills a pixel when the primary label is not
    in the keep set and its own id is positive; the fused label is the primary one
    (kept or not) overwritten by the fill.
    """
    both = align_layers({"p": primary, "s": secondary})
    kept = F.coalesce(F.col("p").isin([int(k) for k in keep_ids]), F.lit(False))
    fills = ~kept & F.coalesce(F.col("s") > 0, F.lit(False))
    return both.select(
        *PIXEL,
        F.when(kept, F.col("p")).alias("kept"),
        F.when(fills, F.col("s")).alias("filled"),
        F.when(fills, F.col("s")).otherwise(F.col("p")).alias("fused"),
    )


def to_binary(pixels: DataFrame, positive_ids: Iterable[int]) -> DataFrame:
    return pixels.withColumn("label", labels.to_binary(F.col("label"), positive_ids))


def resample_nearest(pixels: DataFrame, source_dims: DataFrame, target_dims: DataFrame) -> DataFrame:
    """Nearest-neighbour resize of each image from its source to its target size.

    Target pixel t reads source pixel floor(t * source / target), so each source
    pixel knows its target range and simply emits it: no target grid is built
    and only the sizes are joined.
    """
    sizes = source_dims.select(
        "image", F.col("height").cast("long").alias("_h0"), F.col("width").cast("long").alias("_w0")
    ).join(
        target_dims.select(
            "image", F.col("height").cast("long").alias("_h"), F.col("width").cast("long").alias("_w")
        ),
        "image",
    )
    rest = [c for c in pixels.columns if c not in PIXEL]
    out = lookup_join(pixels, sizes, ["image"])
    for axis, size, size0 in (("y", "_h", "_h0"), ("x", "_w", "_w0")):
        first = F.ceil(F.col(axis) * F.col(size) / F.col(size0)).cast("int")
        last = (F.ceil((F.col(axis) + 1) * F.col(size) / F.col(size0)) - 1).cast("int")
        cells = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        out = out.withColumn(axis, F.explode(cells))
    return out.select(*PIXEL, *rest)


def distinct_labels(pixels: DataFrame) -> DataFrame:
    return pixels.select("image", "label").distinct()


def error_pixels(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Per labelled truth pixel: is the prediction right?"""
    both = align_layers({"pred": pred, "truth": truth})
    return both.filter(F.col("truth").isNotNull()).select(
        *PIXEL, "pred", "truth", labels.error_flag(F.col("pred"), F.col("truth")).alias("correct")
    )


def union_masks(masks: DataFrame) -> DataFrame:
    """Union of many masks of an image: one row per covered pixel."""
    return masks.select(*PIXEL).distinct()


def mask_by_truth(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows of any layer or method whose pixel has a truth label."""
    return rows.join(truth.select(*PIXEL), list(PIXEL), "left_semi")
