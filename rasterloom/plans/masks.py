"""Transfer of text-prompted masks from one anchor frame to all frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import instances, inventory
from rasterloom.operators.joins import lookup_join


def anchor_selection(
    instance_pixels: DataFrame, masks: DataFrame, anchor: str | None = None, threshold: float = 0.7
) -> DataFrame:
    """(class_id, instance_id) whose area on the anchor frame is mostly inside the class mask.

    ``masks`` holds the covered pixels (class_id, y, x) of the anchor frame.
    """
    frame = inventory.anchor_image(instance_pixels.select("image"), anchor)
    on_anchor = lookup_join(instance_pixels, frame, ["image"], "left_semi")
    area = on_anchor.groupBy("instance_id").agg(F.count("*").alias("area"))
    inside = (
        on_anchor.join(masks.select("class_id", "y", "x").distinct(), ["y", "x"])
        .groupBy("class_id", "instance_id")
        .agg(F.count("*").alias("inside"))
    )
    return (
        inside.join(area, "instance_id")
        .filter(F.col("inside") / F.col("area") > F.lit(float(threshold)))
        .select("class_id", "instance_id")
    )


def transfer_masks(
    instance_pixels: DataFrame, masks: DataFrame, anchor: str | None = None, threshold: float = 0.7
) -> DataFrame:
    """Mask pixels (class_id, image, y, x) on every frame."""
    selected = anchor_selection(instance_pixels, masks, anchor, threshold)
    return instances.transfer_mask(instance_pixels, selected).select("class_id", "image", "y", "x")
