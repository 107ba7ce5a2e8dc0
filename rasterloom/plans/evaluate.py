"""Two-level evaluation of predictions against a fused ground truth."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import labels
from rasterloom.operators import metrics, neighborhood, raster
from rasterloom.operators.joins import lookup_join
from rasterloom.session import cut_lineage, work_folder

# The classes that count as positive at the binary level by default.
DEFAULT_POSITIVE = (1, 2, 3, 12)


@dataclass(frozen=True)
class EvaluationConfig:
    class_names: Mapping[int, str]
    positive_ids: tuple[int, ...] = DEFAULT_POSITIVE
    negative_ids: tuple[int, ...] = ()
    positive_id: int = 200
    negative_id: int = 201
    boundary_ratio: float = 0.02


@dataclass
class Evaluation:
    """Lazy result tables; each runs when used.

    ``pixels`` has one row per pixel with the truth and all predictions,
    ``outcomes`` the counts that the class scores follow from.
    """

    pixels: DataFrame
    outcomes: DataFrame
    methods: tuple[str, ...]
    config: EvaluationConfig
    count: Callable[[DataFrame], DataFrame]

    def stored(self) -> "Evaluation":
        """The same with pixels written once and outcomes checkpointed, so that all tables derive from files."""
        folder = work_folder(self.pixels.sparkSession, "evaluation")
        self.pixels.write.parquet(folder)
        pixels = self.pixels.sparkSession.read.schema(self.pixels.schema).parquet(folder)
        return Evaluation(pixels, cut_lineage(self.count(pixels)), self.methods, self.config, self.count)

    def _per_method(self, *kinds: str) -> Column:
        """Array of (method, columns of that method) for a pixel."""
        return F.array(
            *[
                F.struct(F.lit(m).alias("method"), *[F.col(f"_{k}{i}").alias(f"pred_{k}") for k in kinds])
                for i, m in enumerate(self.methods)
            ]
        )

    @property
    def image_binary(self) -> DataFrame:
        """Binary scores per method and image."""
        truth = labels.to_binary(F.col("gt"), self.config.positive_ids)
        counted = (
            self.pixels.filter(F.col("gt").isNotNull())
            .select("image", truth.alias("gt"), F.explode(self._per_method("binary")).alias("_m"))
            .select("image", "gt", "_m.*")
        )
        counts = metrics.binary_counts(counted, by=("method", "image"), pred="pred_binary")
        return metrics.binary_metrics(counts)

    @property
    def image_class(self) -> DataFrame:
        """Class scores per method and image, for the classes in the image's truth."""
        scores = metrics.class_metrics(metrics.class_counts(self.outcomes, by=("pred_no", "image")))
        names = F.array(*[F.lit(m) for m in self.methods])
        return scores.withColumn("method", F.get(names, F.col("pred_no"))).drop("pred_no")

    @property
    def image_summary(self) -> DataFrame:
        return metrics.image_summary(self.image_class, by=("method", "image"))

    @property
    def report_binary(self) -> DataFrame:
        return metrics.report_binary(self.image_binary)

    @property
    def report_overall(self) -> DataFrame:
        return metrics.report_overall(self.image_summary)

    @property
    def report_class(self) -> DataFrame:
        names = F.create_map(*[p for k, v in self.config.class_names.items() for p in (F.lit(int(k)), F.lit(v))])
        fallback = F.concat(F.lit("class_"), F.col("class_id").cast("string"))
        return metrics.report_class(self.image_class).withColumn(
            "class_name", F.coalesce(F.element_at(names, F.col("class_id")), fallback)
        )

    @property
    def prediction_cache(self) -> DataFrame:
        """Per pixel: binary and class prediction and the two-level view of it."""
        pos, neg = self.config.positive_ids, self.config.negative_ids
        view = labels.collapse_levels(
            F.col("pred_class"),
            pos,
            neg,
            self.config.positive_id,
            self.config.negative_id,
            force_positive=F.col("pred_binary") == 1,
        )
        return (
            self.pixels.select(*raster.PIXEL, F.explode(self._per_method("binary", "class")).alias("_m"))
            .select(*raster.PIXEL, "_m.*")
            .withColumn("pred_view", view)
        )


def evaluate(
    primary: DataFrame,
    secondary: DataFrame,
    dims: DataFrame,
    predictions: Mapping[str, DataFrame],
    config: EvaluationConfig,
    prediction_dims: Mapping[str, DataFrame] | None = None,
) -> Evaluation:
    """Score any number of methods in one pass over the pixels.

    ``predictions`` maps a method to pixels(image, y, x, pred_binary, pred_class).
    Methods with an entry in ``prediction_dims`` are resized to the truth first.
    All layers meet in a single shuffle by line, whatever the number of methods;
    region and boundary counts then come from one further shuffle, of runs by tile.
    """
    known = tuple(config.class_names)
    tables = [
        raster.drop_unknown(primary, known).withColumnRenamed("label", "_primary"),
        raster.drop_unknown(secondary, known).withColumnRenamed("label", "_secondary"),
    ]
    for i, (method, pred) in enumerate(predictions.items()):
        if prediction_dims and method in prediction_dims:
            pred = raster.resample_nearest(pred, prediction_dims[method], dims)
        tables.append(
            pred.select(
                *raster.PIXEL, F.col("pred_binary").alias(f"_binary{i}"), F.col("pred_class").alias(f"_class{i}")
            )
        )
    wide = raster.align_columns([t.select(*raster.PIXEL, *t.columns[3:]) for t in tables], lines=True).withColumn(
        "gt", F.coalesce("_primary", "_secondary")
    )

    def count(pixels: DataFrame) -> DataFrame:
        sized = neighborhood.with_boundary_width(pixels.filter(F.col("gt").isNotNull()), dims, config.boundary_ratio)
        return neighborhood.pixel_outcomes(sized, [f"_class{i}" for i in range(len(predictions))])

    return Evaluation(wide, count(wide), tuple(predictions), config, count)


def compare_methods(
    cache: DataFrame, truth: DataFrame | None = None, also: Sequence[DataFrame] = ()
) -> DataFrame:
    """Rows of all methods on the images that every present method, and every table of ``also``, has.

    ``cache`` has method, image, y, x and prediction columns. With ``truth`` only
    pixels that carry a truth label stay.
    """
    # one row per method and image, stored once because both counts below read it
    present = cut_lineage(cache.select("method", "image").distinct())
    wanted = present.agg(F.count_distinct("method").alias("n")).scalar()
    common = (
        present.groupBy("image").agg(F.count("*").alias("n")).filter(F.col("n") == wanted).select("image")
    )
    for table in also:
        common = common.join(table.select("image").distinct(), "image", "left_semi")
    out = lookup_join(cache, common, ["image"], "left_semi")
    return out if truth is None else raster.mask_by_truth(out, truth)
