"""A whole evaluation run: check inputs, predict, score, compare, store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from rasterloom.operators import inventory, metrics, raster
from rasterloom.operators.joins import lookup_join
from rasterloom.plans.evaluate import Evaluation, EvaluationConfig, compare_methods, evaluate
from rasterloom.plans.predictors import Predictor
from rasterloom.sinks import tables


@dataclass(frozen=True)
class RunConfig:
    evaluation: EvaluationConfig
    first_images: int | None = None
    stability_ids: tuple[int, ...] = (101, 103, 104)


def check_inputs(predictors: Sequence[Predictor], images: DataFrame, files: DataFrame) -> None:
    """Every method's inputs are looked for before any method runs."""
    for predictor in predictors:
        inventory.require_inputs(predictor.required_inputs(images), files, predictor.name)


def run_evaluation(
    primary: DataFrame,
    secondary: DataFrame,
    dims: DataFrame,
    predictors: Sequence[Predictor],
    config: RunConfig,
    files: DataFrame | None = None,
    secondary_dims: DataFrame | None = None,
    prediction_dims: Mapping[str, DataFrame] | None = None,
) -> Evaluation:
    """Score all methods on the (first) images that have both truth layers.

    ``dims`` are the sizes of the primary layer. The secondary layer's sizes must
    agree; where they are not given, none of its pixels may lie outside. A method with sizes of its own, in
    ``prediction_dims`` or as its predictor's ``dims``, is resized to the truth.
    """
    inventory.require_complete(primary, secondary)
    if secondary_dims is not None:
        raster.require_same_shape(dims, secondary_dims)
    else:
        raster.require_inside(secondary, dims)
    images = inventory.first_images(primary, config.first_images)
    if files is not None:
        check_inputs(predictors, images, files)

    def chosen(pixels: DataFrame) -> DataFrame:
        return pixels if not config.first_images else lookup_join(pixels, images, ["image"], "left_semi")

    predictions = {p.name: chosen(p.predict()) for p in predictors}
    own = {p.name: p.dims for p in predictors if getattr(p, "dims", None) is not None} | dict(prediction_dims or {})
    return evaluate(chosen(primary), chosen(secondary), dims, predictions, config.evaluation, own)


def store(done: Evaluation, folder: str, config: RunConfig, previous_summary: str | None = None) -> None:
    """Reports, per-image scores, summary, stability subset and prediction cache.

    Pixels are aligned once and stored; everything is derived from that table.
    """
    done = done.stored()
    overall, per_class = done.report_overall, done.report_class
    report = tables.nested_report(overall, per_class, done.report_binary)
    tables.write_reports(report, done.image_class, folder)
    tables.upsert_summary(overall, f"{folder}/summary", previous_summary)
    subset = metrics.stability_subset(per_class, overall, config.stability_ids)
    tables.write_stability(subset, f"{folder}/stability")
    tables.write_prediction_cache(done.prediction_cache, f"{folder}/predictions")


def comparison(
    cache: DataFrame,
    truth: DataFrame | None = None,
    pictures: DataFrame | None = None,
    layers: Sequence[DataFrame] = (),
) -> DataFrame:
    """Predictions of all stored methods on the images that the pictures and both truth layers have too."""
    return compare_methods(cache, truth, [t for t in (pictures, *layers) if t is not None])
