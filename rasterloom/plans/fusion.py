"""Fusion of projected labels with predicted labels into ground-truth layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from rasterloom.operators import inventory, raster

# Classes of the scene-parsing vocabulary that the fused truth uses.
DEFAULT_ID_MAP = {2: 100, 4: 101, 6: 102, 13: 102, 12: 103, 20: 104}
DEFAULT_KEEP_IDS = (1, 2, 3, 12)


@dataclass(frozen=True)
class FusionConfig:
    keep_ids: Sequence[int] = DEFAULT_KEEP_IDS
    id_map: Mapping[int, int] = field(default_factory=lambda: dict(DEFAULT_ID_MAP))
    merge_map: Mapping[int, Sequence[int]] | None = None
    extensions: Sequence[str] = (".png", ".jpg", ".jpeg", ".JPG", ".PNG")
    strict: bool = False


def paired_images(projected: DataFrame, pictures: DataFrame, config: FusionConfig) -> DataFrame:
    """(name, path) for projected images with a picture; the others are skipped, or raise."""
    names = projected.select(projected["image"].alias("name"))
    matched = inventory.match_files(names, pictures, config.extensions, strict=config.strict)
    return matched.filter(matched["path"].isNotNull())


def fuse_layers(
    projected: DataFrame,
    predicted: DataFrame,
    dims: DataFrame,
    config: FusionConfig = FusionConfig(),
    predicted_dims: DataFrame | None = None,
) -> DataFrame:
    """Kept primary, secondary fill and fused label per pixel.

    ``predicted`` is in the model's vocabulary and is resized to ``dims`` when its
    own size is given.
    """
    if config.merge_map:
        projected = raster.merge_labels(projected, config.merge_map)
    if predicted_dims is not None:
        predicted = raster.resample_nearest(predicted, predicted_dims, dims)
    mapped = raster.map_labels(predicted, config.id_map)
    return raster.split_layers(projected, mapped, config.keep_ids)
