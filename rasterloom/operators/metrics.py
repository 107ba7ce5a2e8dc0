"""Scores from counts: per image and class, per image, per method."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.raster import align_layers

EPS = 1e-9


def ratio(part: Column, whole: Column) -> Column:
    """part / (whole + eps): defined, and 0, where the whole is 0."""
    return part / (whole + F.lit(EPS))


def align_truth(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Truth pixels with their prediction; a missing prediction is NULL, never dropped."""
    return align_layers({"gt": truth, "pred": pred}).filter(F.col("gt").isNotNull())


def confusion(aligned: DataFrame, by: Sequence[str] = ("image",)) -> DataFrame:
    """Pixel counts per truth and predicted class: the one pass over the pixels."""
    return (
        aligned.filter(F.col("gt").isNotNull())
        .groupBy(*by, "gt", "pred")
        .agg(F.count("*").alias("n"))
    )


def class_counts(counts: DataFrame, by: Sequence[str] = ("image",)) -> DataFrame:
    """tp, fp, fn, tn per class present in the truth, from confusion counts.

    Extra columns ``gt_boundary`` and ``pred_boundary`` add the boundary counts.
    """
    by = list(by)
    n = F.col("n")
    same = F.col("gt").eqNullSafe(F.col("pred"))
    has_boundary = "gt_boundary" in counts.columns
    zero = F.lit(0).cast("long")
    on_gt = F.when(F.col("gt_boundary"), n).otherwise(zero) if has_boundary else zero
    on_pred = F.when(F.col("pred_boundary"), n).otherwise(zero) if has_boundary else zero
    on_both = (
        F.when(same & F.col("gt_boundary") & F.col("pred_boundary"), n).otherwise(zero)
        if has_boundary
        else zero
    )
    as_truth = F.struct(
        F.col("gt").alias("class_id"),
        n.alias("actual"),
        zero.alias("predicted"),
        F.when(same, n).otherwise(zero).alias("tp"),
        n.alias("pixels"),
        on_gt.alias("b_gt"),
        zero.alias("b_pred"),
        on_both.alias("b_both"),
    )
    as_pred = F.struct(
        F.col("pred").alias("class_id"),
        zero.alias("actual"),
        n.alias("predicted"),
        zero.alias("tp"),
        zero.alias("pixels"),
        zero.alias("b_gt"),
        on_pred.alias("b_pred"),
        zero.alias("b_both"),
    )
    sums = (
        counts.select(*by, F.explode(F.array(as_truth, as_pred)).alias("s"))
        .select(*by, "s.*")
        .filter(F.col("class_id").isNotNull())
        .groupBy(*by, "class_id")
        .agg(
            *[
                F.sum(c).alias(c)
                for c in ("actual", "predicted", "tp", "pixels", "b_gt", "b_pred", "b_both")
            ]
        )
    )
    # the rows are already one per class, so a window over them stays small
    totals = F.sum("pixels").over(Window.partitionBy(*by))
    out = sums.withColumn("total", totals).filter(F.col("actual") > 0)
    boundary = (
        [
            F.col("b_both").alias("boundary_inter"),
            (F.col("b_gt") + F.col("b_pred") - F.col("b_both")).alias("boundary_union"),
        ]
        if has_boundary
        else []
    )
    return out.select(
        *by,
        "class_id",
        "tp",
        (F.col("predicted") - F.col("tp")).alias("fp"),
        (F.col("actual") - F.col("tp")).alias("fn"),
        (F.col("total") - F.col("actual") - F.col("predicted") + F.col("tp")).alias("tn"),
        *boundary,
    )


def class_metrics(counts: DataFrame) -> DataFrame:
    """IoU, precision and recall per row of counts, and boundary IoU where counted."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns(
        {"iou": ratio(tp, tp + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)}
    )
    if "boundary_union" in counts.columns:
        union = F.col("boundary_union")
        out = out.withColumn(
            "boundary_iou",
            F.when(union == 0, F.lit(1.0)).otherwise(F.col("boundary_inter") / F.greatest(union, F.lit(1))),
        )
    return out


def binary_counts(
    aligned: DataFrame, by: Sequence[str] = ("image",), pred: str = "pred", truth: str = "gt"
) -> DataFrame:
    """tp, tn, fp, fn over pixels with a truth value; a missing prediction is negative."""
    p = F.coalesce(F.col(pred) == 1, F.lit(False))
    t = F.col(truth) == 1
    return (
        aligned.filter(F.col(truth).isNotNull())
        .groupBy(*by)
        .agg(
            F.count_if(p & t).alias("tp"),
            F.count_if(~p & ~t).alias("tn"),
            F.count_if(p & ~t).alias("fp"),
            F.count_if(~p & t).alias("fn"),
        )
    )


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Binary scores from tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns(
        {
            "iou": ratio(tp, tp + fp + fn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "pixel_count": tp + tn + fp + fn,
        }
    )


def image_summary(scores: DataFrame, by: Sequence[str] = ("image",)) -> DataFrame:
    """Mean class IoU (and boundary IoU) over the truth's classes and pixel accuracy."""
    means = [F.avg("iou").alias("mean_iou")]
    if "boundary_iou" in scores.columns:
        means.append(F.avg("boundary_iou").alias("mean_boundary_iou"))
    return scores.groupBy(*by).agg(
        *means,
        F.sum("tp").alias("correct_count"),
        F.sum(F.col("tp") + F.col("fn")).alias("pixel_count"),
        (F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("pixel_acc"),
    )


def report_binary(scores: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Number of images and the mean of each binary score over images."""
    names = ("iou", "precision", "recall", "accuracy", "f1")
    return scores.groupBy(*by).agg(F.count("*").alias("n_images"), *[F.avg(m).alias(m) for m in names])


def report_overall(summaries: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Number of images and the mean of the per-image class-level scores."""
    names = [c for c in ("mean_iou", "mean_boundary_iou", "pixel_acc") if c in summaries.columns]
    return summaries.groupBy(*by).agg(F.count("*").alias("n_images"), *[F.avg(m).alias(m) for m in names])


def report_class(scores: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Per class: mean scores over the images whose truth has it, and summed counts."""
    names = [c for c in ("iou", "boundary_iou", "precision", "recall") if c in scores.columns]
    return scores.groupBy(*by, "class_id").agg(
        *[F.avg(m).alias(m) for m in names], *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    )


def stability_subset(per_class: DataFrame, overall: DataFrame, class_ids: Iterable[int]) -> DataFrame:
    """Scores and counts of chosen classes next to the method's overall mean IoU."""
    return per_class.filter(F.col("class_id").isin([int(c) for c in class_ids])).join(
        overall.select("method", F.col("mean_iou").alias("overall_mean_iou")), "method"
    )


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str] = ("method",)) -> DataFrame:
    """New rows replace the old rows of the same key; other old rows stay."""
    fresh = new.select(*key).distinct()
    return existing.join(fresh, list(key), "left_anti").unionByName(new, allowMissingColumns=True)
