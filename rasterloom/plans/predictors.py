"""Three ways to turn model output into class rasters, behind one interface.

Models themselves are not part of this package; their outputs are input tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import vectors
from rasterloom.operators import features, hierarchy, instances, raster
from rasterloom.operators.joins import lookup_join


class Predictor(Protocol):
    """Gives pixels(image, y, x, pred_binary, pred_class) and names what it reads."""

    name: str

    def required_inputs(self, images: DataFrame) -> DataFrame:
        """(image, label, path): one row per candidate path of each needed input."""

    def predict(self) -> DataFrame: ...


def required_paths(images: DataFrame, label: str, patterns: Sequence[str]) -> DataFrame:
    """Candidate paths per image; ``{}`` in a pattern stands for the image name."""
    candidates = F.array(*[F.replace(F.lit(p), F.lit("{}"), F.col("image").cast("string")) for p in patterns])
    return images.select("image", F.lit(label).alias("label"), F.explode(candidates).alias("path"))


@dataclass
class HierarchyPredictor:
    """Instances labelled by the entity tree, the rest by embedding similarity."""

    instance_pixels: DataFrame
    entities: DataFrame
    instance_entity: DataFrame
    instance_features: DataFrame
    prompt_vectors: DataFrame
    class_types: Mapping[int, Sequence[str]]
    positive_ids: Sequence[int]
    threshold: float = 0.2
    name: str = "hierarchy"
    input_patterns: Sequence[str] = ("{}.png",)

    def required_inputs(self, images: DataFrame) -> DataFrame:
        return required_paths(images, "instance_raster", self.input_patterns)

    def instance_labels(self) -> DataFrame:
        known = hierarchy.hierarchy_labels(self.entities, self.instance_entity, self.class_types)
        prototypes = instances.instance_prototypes(instances.without_label(self.instance_features, known))
        classes = instances.class_prototypes(
            self.prompt_vectors.filter(~F.col("class_id").isin([int(c) for c in self.class_types]))
        )
        guessed = instances.classify_instances(prototypes, classes, self.threshold)
        return instances.override_labels(guessed.select("instance_id", "label"), known)

    def predict(self) -> DataFrame:
        labelled = instances.rasterize(self.instance_pixels, self.instance_labels())
        positive = F.col("label").isin([int(c) for c in self.positive_ids])
        return labelled.select(
            *raster.PIXEL, F.when(positive, F.lit(1)).alias("pred_binary"), F.col("label").alias("pred_class")
        )


@dataclass
class FeaturePredictor:
    """Per-pixel features scored against binary and class prompts."""

    feature_pixels: DataFrame
    binary_prompts: Sequence[Sequence[float]]
    class_prompts: Sequence[Sequence[float]]
    class_ids: Sequence[int]
    negatives: Sequence[Sequence[float]]
    decoder: Sequence[tuple[np.ndarray, np.ndarray]] | None = None
    binary_threshold: float = 0.35
    class_threshold: float = 0.4
    use_softmax: bool = False
    dense: bool = False
    name: str = "features"
    input_patterns: Sequence[str] = ("{}.npy",)

    def required_inputs(self, images: DataFrame) -> DataFrame:
        return required_paths(images, "rendered_feature", self.input_patterns)

    def predict(self) -> DataFrame:
        pixels = self.feature_pixels
        if self.decoder is not None:
            pixels = features.decode_vectors(pixels, self.decoder)
        groups = {"_b": self.binary_prompts, "_c": self.class_prompts}
        scored = features.relevancy_groups(pixels, groups, self.negatives, self.dense).drop("feature")
        sizes = {name: len(prompts) for name, prompts in groups.items()}
        scored = features.query_confidence(scored, sizes, self.use_softmax)
        ids = F.array(*[F.lit(int(c)) for c in self.class_ids])
        return scored.select(
            *raster.PIXEL,
            F.when(F.col("_b_confidence") >= F.lit(float(self.binary_threshold)), F.lit(1)).alias("pred_binary"),
            features.threshold_label(
                vectors.pick(ids, F.col("_c_query")), F.col("_c_confidence"), self.class_threshold
            ).alias("pred_class"),
        )


@dataclass
class BoxPredictor:
    """Instances take the class of the detection box that covers them best.

    ``binary_boxes`` and ``class_boxes`` are raw detections with class_id; see
    ``normalize_boxes`` for ``frames``. ``dims`` is the instance raster's size.
    """

    instance_pixels: DataFrame
    binary_boxes: DataFrame
    class_boxes: DataFrame
    frames: DataFrame
    dims: DataFrame
    box_format: str = "guess"
    min_overlap: float = 0.3
    min_score: float = 0.2
    name: str = "boxes"
    input_patterns: Sequence[str] = ("{}.png",)

    def required_inputs(self, images: DataFrame) -> DataFrame:
        return required_paths(images, "instance_raster", self.input_patterns)

    def _boxes(self, raw: DataFrame, kind: int) -> DataFrame:
        """Boxes in the raster's frame; the lowest bit of the prompt's number tells the two sets apart."""
        boxes = instances.normalize_boxes(raw, self.frames, self.box_format)
        boxes = instances.scale_boxes(boxes, self.frames, self.dims)
        return boxes.withColumn("prompt_idx", F.col("prompt_idx") * 2 + kind)

    def predict(self) -> DataFrame:
        """Both sets of boxes meet the pixels once, and vote apart."""
        on = ["image", "instance_id"]
        boxes = self._boxes(self.binary_boxes, 0).unionByName(self._boxes(self.class_boxes, 1))
        overlaps = instances.box_overlap(self.instance_pixels, boxes).withColumn("_kind", F.col("prompt_idx") % 2)
        votes = instances.vote_labels(overlaps, boxes, self.min_overlap, self.min_score, ["_kind"])
        both = votes.groupBy(*on).agg(
            *[F.max(F.when(F.col("_kind") == k, F.col("label"))).alias(n) for k, n in enumerate(("pred_binary", "pred_class"))]
        )
        return lookup_join(self.instance_pixels, both, on).select(*raster.PIXEL, "pred_binary", "pred_class")
