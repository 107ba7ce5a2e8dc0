"""Instance ids: picking, transferring, rasterising and classifying them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import vectors
from rasterloom.operators.joins import lookup_join
from rasterloom.session import cut_lineage

# Prototype vectors that one task compares at once.
PROTOTYPE_BLOCK = 4096
# Instances, in vectors of 512 numbers, that meet a block of prototypes at once (about 64 MB).
INSTANCE_BLOCK = 16_384


def select_by_share(pixels: DataFrame, threshold: float = 0.7, by: Sequence[str] = ("image",)) -> DataFrame:
    """Instances whose area lies inside ``mask`` by more than ``threshold`` (strict; id 0 too)."""
    inside = F.sum(F.when(F.col("mask").cast("int") == 1, 1).otherwise(0))
    return (
        pixels.groupBy(*by, "instance_id")
        .agg(F.count("*").alias("area"), inside.alias("inside"))
        .withColumn("share", F.col("inside") / F.col("area"))
        .filter(F.col("share") > F.lit(float(threshold)))
    )


def transfer_mask(pixels: DataFrame, selected: DataFrame) -> DataFrame:
    """Sparse masks on all frames: pixels whose instance is selected, once per class.

    ``selected`` is (class_id, instance_id); one instance may serve several classes.
    """
    return lookup_join(pixels, selected.select("class_id", "instance_id").distinct(), ["instance_id"])


def mask_flags(pixels: DataFrame, selected: DataFrame, class_ids: Sequence[int]) -> DataFrame:
    """Dense form of ``transfer_mask``: 0 or 255 for every pixel and listed class."""
    classes = selected.groupBy("instance_id").agg(F.collect_set("class_id").alias("_classes"))
    wanted = F.array(*[F.lit(int(c)) for c in class_ids])
    return (
        lookup_join(pixels, classes, ["instance_id"], "left")
        .withColumn("class_id", F.explode(wanted))
        .withColumn(
            "value",
            F.when(F.array_contains("_classes", F.col("class_id")), F.lit(255)).otherwise(F.lit(0)),
        )
        .drop("_classes")
    )


def rasterize(pixels: DataFrame, labels: DataFrame, on: Sequence[str] = ("instance_id",)) -> DataFrame:
    """Instance raster to class raster; ids without a label give no pixel.

    ``labels`` is (instance_id, label), or (image, instance_id, label) with ``on``.
    """
    # checkpointed, so that its size can be looked at without computing it twice
    wanted = cut_lineage(labels.filter(F.col("label").isNotNull()).select(*on, "label"))
    return lookup_join(pixels, wanted, on).select("image", "y", "x", "label")


# --- embeddings -------------------------------------------------------------------


def mean_vectors(df: DataFrame, key: Sequence[str], vector: str = "feature") -> DataFrame:
    """Component-wise mean of the vectors of each key.

    Whole vectors are summed in the aggregate, so rows are neither multiplied by
    their length nor gathered: tasks combine a key's rows before the shuffle.
    """
    summed = df.groupBy(*key).agg(Summarizer.mean(array_to_vector(vector)).alias("_mean"))
    return summed.select(*key, vector_to_array("_mean").alias(vector))


def usable_features(features: DataFrame) -> DataFrame:
    """Drop instance 0 and vectors without length, and scale the rest to length one."""
    length = vectors.norm(F.col("feature"))
    return features.filter((F.col("instance_id") != 0) & (length > F.lit(vectors.EPS))).withColumn(
        "feature", vectors.scale(F.col("feature"), length)
    )


def instance_prototypes(features: DataFrame) -> DataFrame:
    """One vector per instance: the mean of its normalised vectors; id 0 is left out."""
    unit = features.filter(F.col("instance_id") != 0).withColumn(
        "feature", vectors.l2_normalize(F.col("feature"))
    )
    return mean_vectors(unit, ["instance_id"])


def class_prototypes(prompts: DataFrame, key: str = "class_id") -> DataFrame:
    """One unit vector per class: the mean of its normalised prompt vectors, rescaled."""
    unit = prompts.withColumn("feature", vectors.l2_normalize(F.col("feature"), 0.0))
    return mean_vectors(unit, [key]).withColumn("feature", vectors.l2_normalize(F.col("feature"), 0.0))


def prompt_rows(prototypes: DataFrame, key: str = "class_id") -> list[tuple[int, list[float]]]:
    """Prompt vectors of a class configuration on the driver, ordered by id."""
    rows = prototypes.select(key, "feature").orderBy(key).collect()
    return [(int(r[0]), [float(v) for v in r[1]]) for r in rows]


def classify_instances(
    instances: DataFrame, prototypes: DataFrame, threshold: float, key: str = "class_id"
) -> DataFrame:
    """Most similar class per instance, NULL below ``threshold``; lowest id on a tie.

    Blocks of instances meet blocks of at most about ``PROTOTYPE_BLOCK``
    prototypes as matrix products; each instance keeps one best class per block,
    and the best of those wins. Neither side passes through the driver, and a
    task holds one block of each, whatever their number: blocks of instances have
    about ``INSTANCE_BLOCK`` vectors, fewer where vectors are longer than 512.
    """
    classes = prototypes.select(F.col(key).cast("int").alias("label"), F.col("feature").cast("array<double>").alias("feature"))
    blocks = -(-classes.count() // PROTOTYPE_BLOCK)
    if not blocks:
        return instances.select("instance_id", F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("score"))
    held = instances.agg(F.sum(F.greatest(F.size("feature") / F.lit(512.0), F.lit(1.0))).alias("size")).first()
    parts = max(instances.sparkSession.sparkContext.defaultParallelism, math.ceil((held["size"] or 0) / INSTANCE_BLOCK))
    unit = vectors.l2_normalize(F.col("feature"))
    # copies of an instance are told apart by their vectors
    left = instances.select("instance_id", unit.alias("feature")).withColumns(
        {
            "_part": F.pmod(F.xxhash64("instance_id", "feature"), F.lit(parts)).cast("int"),
            "_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))),
        }
    )
    right = classes.withColumns(
        {
            "_block": F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int"),
            "_part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))),
        }
    )

    def best(some: pa.Table, table: pa.Table) -> pa.Table:
        names = ["instance_id", "feature", "label", "score"]
        kinds = [some.schema.field("instance_id").type, some.schema.field("feature").type, pa.int32(), pa.float64()]
        if not some.num_rows or not table.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        order = np.argsort(table.column("label").to_numpy(), kind="stable")
        label = table.column("label").to_numpy()[order]
        matrix = np.stack(table.column("feature").to_pylist())[order]
        out = []
        for batch in some.to_batches(max_chunksize=4096):
            if not batch.num_rows:
                continue
            # summed in the same order for every pair, so that equal prototypes tie exactly
            scores = np.einsum("ij,kj->ik", np.stack(batch.column("feature").to_pylist()), matrix)
            place = scores.argmax(axis=1)  # the first of equals, so the lowest id
            columns = [batch.column("instance_id"), batch.column("feature"), pa.array(label[place], pa.int32())]
            out.append(pa.RecordBatch.from_arrays([*columns, pa.array(scores[np.arange(len(place)), place])], names))
        return pa.Table.from_batches(out)

    kind = instances.schema["instance_id"].dataType.simpleString()
    found = (
        left.groupBy("_part", "_block")
        .cogroup(right.groupBy("_part", "_block"))
        .applyInArrow(
            lambda a, b: best(a.select(["instance_id", "feature"]), b.select(["label", "feature"])),
            f"instance_id {kind}, feature array<double>, label int, score double",
        )
    )
    if blocks > 1:
        rank = F.struct(F.col("score"), -F.col("label"))
        found = found.groupBy("instance_id", "feature").agg(F.max(rank).alias("_b"), F.max("score").alias("score"))
        found = found.withColumn("label", -F.col("_b.col2"))
    return found.select(
        "instance_id", F.when(F.col("score") >= F.lit(float(threshold)), F.col("label")).alias("label"), "score"
    )


def without_label(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Instances that have features but no label from the hierarchy."""
    known = labels.filter(F.col("label").isNotNull()).select("instance_id").distinct()
    return lookup_join(features, known, ["instance_id"], "left_anti")


def override_labels(base: DataFrame, preferred: DataFrame) -> DataFrame:
    """Union of two label tables; where both know an instance the preferred one wins."""
    marked = base.select("instance_id", F.col("label").alias("b"), F.lit(None).cast("int").alias("p")).unionByName(
        preferred.select("instance_id", F.lit(None).cast("int").alias("b"), F.col("label").alias("p"))
    )
    return (
        marked.groupBy("instance_id")
        .agg(F.max("p").alias("p"), F.max("b").alias("b"))
        .select("instance_id", F.coalesce("p", "b").alias("label"))
    )


# --- detection boxes --------------------------------------------------------------

BOX = ("image", "prompt_idx", "box_idx")
_CELL = 32


def normalize_boxes(
    boxes: DataFrame, frames: DataFrame, box_format: str = "guess"
) -> DataFrame:
    """Raw detector boxes (b0..b3) to ordered, clipped corners x1, y1, x2, y2.

    ``frames`` gives per image the size the detector saw (det_width, det_height)
    and the image's own size (width, height). A batch is one image and prompt.
    Batches with no value above 1.5 are fractions of the detector size. With
    ``guess`` a batch counts as centre format when more than 30 % of its boxes
    have inverted corners; ``corner`` and ``center`` state the format.
    """
    if box_format not in ("guess", "corner", "center"):
        raise ValueError(f"unknown box format {box_format!r}")
    batch = ["image", "prompt_idx"]
    b = [F.col(f"b{i}").cast("double") for i in range(4)]
    stats = boxes.groupBy(*batch).agg(
        F.max(F.greatest(*b)).alias("_top"),
        F.avg(((b[2] < b[0]) | (b[3] < b[1])).cast("double")).alias("_inverted"),
    )
    if box_format == "guess":
        centered = F.col("_inverted") > 0.3
    else:
        centered = F.lit(box_format == "center")
    sized = lookup_join(boxes.join(stats, batch), frames, ["image"])
    fraction = F.col("_top") <= 1.5
    unit_x = F.when(fraction, F.col("det_width").cast("double")).otherwise(1.0)
    unit_y = F.when(fraction, F.col("det_height").cast("double")).otherwise(1.0)
    sized = sized.withColumns({"_a": b[0] * unit_x, "_b": b[1] * unit_y, "_c": b[2] * unit_x, "_d": b[3] * unit_y})

    def corners(low: str, high: str, size: str, det: str) -> tuple[Column, Column]:
        half = F.lit(0.5) * F.col(high)
        zoom = F.col(size) / F.col(det).cast("double")
        first = F.when(centered, F.col(low) - half).otherwise(F.col(low)) * zoom
        second = F.when(centered, F.col(low) + half).otherwise(F.col(high)) * zoom
        top = F.col(size).cast("double") - 1

        def clip(v: Column) -> Column:
            return F.least(F.greatest(v, F.lit(0.0)), top)

        return clip(F.least(first, second)), clip(F.greatest(first, second))

    x1, x2 = corners("_a", "_c", "width", "det_width")
    y1, y2 = corners("_b", "_d", "height", "det_height")
    return sized.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2}).select(
        *boxes.columns, "x1", "y1", "x2", "y2"
    )


def scale_boxes(boxes: DataFrame, frames: DataFrame, target: DataFrame) -> DataFrame:
    """Boxes from image size to the instance raster's size."""
    sizes = frames.select("image", "width", "height").join(
        target.select("image", F.col("width").alias("_w"), F.col("height").alias("_h")), "image"
    )
    sx = F.col("_w") / F.col("width").cast("double")
    sy = F.col("_h") / F.col("height").cast("double")
    return (
        lookup_join(boxes, sizes, ["image"])
        .withColumns(
            {
                "x1": F.col("x1") * sx,
                "y1": F.col("y1") * sy,
                "x2": F.col("x2") * sx,
                "y2": F.col("y2") * sy,
            }
        )
        .select(*boxes.columns)
    )


def box_overlap(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Share of each instance's area inside each box of its image, where positive.

    Bounds round half to even and are half-open. Boxes and pixels meet on cells
    of 32x32 pixels. Cells a box covers entirely contribute their per-instance
    counts; only cells it cuts are looked at pixel by pixel.
    """
    known = pixels.filter(~F.col("instance_id").isin(0, -1)).select("image", "y", "x", "instance_id")
    for axis in ("y", "x"):
        known = known.withColumn(f"_c{axis}", F.floor(F.col(axis) / F.lit(_CELL)).cast("int"))
    cell = ["image", "_cy", "_cx"]
    cells = known.groupBy(*cell, "instance_id").agg(F.count("*").alias("n"))
    area = cells.groupBy("image", "instance_id").agg(F.sum("n").alias("area"))

    bounds = boxes.select(
        *BOX,
        *[
            F.greatest(F.bround(F.col(c).cast("double")), F.lit(0.0)).cast("int").alias(f"_{c}")
            for c in ("x1", "y1", "x2", "y2")
        ],
    ).filter((F.col("_x2") > F.col("_x1")) & (F.col("_y2") > F.col("_y1")))
    for axis in ("y", "x"):
        first = F.floor(F.col(f"_{axis}1") / F.lit(_CELL)).cast("int")
        last = F.floor((F.col(f"_{axis}2") - 1) / F.lit(_CELL)).cast("int")
        bounds = bounds.withColumn(f"_c{axis}", F.explode(F.sequence(first, last)))
    whole = F.lit(True)
    for axis in ("y", "x"):
        start = F.col(f"_c{axis}") * F.lit(_CELL)
        whole = whole & (F.col(f"_{axis}1") <= start) & (start + F.lit(_CELL) <= F.col(f"_{axis}2"))
    bounds = bounds.withColumn("_whole", whole)

    inside = (
        (F.col("x") >= F.col("_x1"))
        & (F.col("x") < F.col("_x2"))
        & (F.col("y") >= F.col("_y1"))
        & (F.col("y") < F.col("_y2"))
    )
    full = cells.join(bounds.filter("_whole"), cell).select(*BOX, "instance_id", "n")
    cut = (
        known.join(bounds.filter(~F.col("_whole")), cell)
        .filter(inside)
        .select(*BOX, "instance_id", F.lit(1).cast("long").alias("n"))
    )
    return (
        full.unionByName(cut)
        .groupBy(*BOX, "instance_id")
        .agg(F.sum("n").alias("inside"))
        .join(area, ["image", "instance_id"])
        .select(*BOX, "instance_id", "inside", "area", (F.col("inside") / F.col("area")).alias("overlap"))
    )


def vote_labels(
    overlaps: DataFrame, boxes: DataFrame, min_overlap: float = 0.3, min_score: float = 0.2, by: Sequence[str] = ()
) -> DataFrame:
    """Class of the box with the highest score times overlap, per image and instance.

    The earliest prompt, then the earliest box, wins a tie. Columns ``by`` of the overlaps part the votes further.
    """
    scored = (
        overlaps.filter(F.col("overlap") >= F.lit(float(min_overlap)))
        .join(boxes.select(*BOX, "class_id", "score"), list(BOX))
        .withColumn("_s", F.col("score") * F.col("overlap"))
        .filter(F.col("_s") > 0)
    )
    order = F.struct("_s", (-F.col("prompt_idx")).alias("p"), (-F.col("box_idx")).alias("b"))
    return (
        scored.groupBy("image", "instance_id", *by)
        .agg(F.max_by("class_id", order).alias("label"), F.max("_s").alias("score"))
        .filter(F.col("score") >= F.lit(float(min_score)))
    )
