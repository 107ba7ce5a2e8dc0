"""Results as parquet and JSON."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rasterloom.operators import metrics
from rasterloom.sinks.ordered import write_ordered


# Folders an image-keyed table is spread over. A folder per image would mean
# millions of them; readers find an image's folder from its name.
IMAGE_BUCKETS = 256


def image_bucket(buckets: int = IMAGE_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col("image").cast("string")), F.lit(buckets)).cast("int")


def _write_by_image(
    rows: DataFrame, folder: str, mode: str, leading: Sequence[str] = (), buckets: int = IMAGE_BUCKETS
) -> None:
    """Parquet in one folder per ``leading`` values and image bucket.

    Blocks of 512 image rows are the unit of shuffling, so neither a large image
    nor a popular one ends up in a single task or file.
    """
    placed = rows.withColumn("image_bucket", image_bucket(buckets))
    block = F.floor(F.col("y") / F.lit(512))
    (
        placed.repartition(*leading, "image", block)
        .write.mode(mode)
        .partitionBy(*leading, "image_bucket")
        .parquet(folder)
    )


def read_images(spark: SparkSession, folder: str, names: Sequence[str], buckets: int = IMAGE_BUCKETS) -> DataFrame:
    """Rows of the named images; only their folders are read."""
    wanted = spark.createDataFrame([(n,) for n in names], "image string")
    found = [r[0] for r in wanted.select(image_bucket(buckets)).distinct().collect()]
    table = spark.read.parquet(folder).filter(F.col("image_bucket").isin(found))
    return table.filter(F.col("image").cast("string").isin([str(n) for n in names])).drop("image_bucket")


def read_all_images(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every image of such a folder; no list of names is needed."""
    return spark.read.parquet(folder).drop("image_bucket")


def write_label_rasters(pixels: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Sparse label rasters."""
    _write_by_image(pixels, folder, mode)


def dense_rasters(pixels: DataFrame, dims: DataFrame, empty: int = -1) -> DataFrame:
    """One row per image row with all its labels, ``empty`` where there is none.

    Rows of an image stay separate, so no task holds a whole image. A line is
    filled by index, so the work is linear in its width. Of several labels of a
    pixel the largest is stored; those outside the image are left out.
    """
    known = pixels.filter(F.col("label").isNotNull())
    lines = known.groupBy("image", "y").agg(F.sort_array(F.collect_list(F.struct("label", "x"))).alias("_at"))
    grid = dims.select(
        "image", "width", F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - 1)).alias("y")
    )
    rows = grid.join(lines, ["image", "y"], "left").select("image", "y", "width", "_at")
    kinds = [dims.schema["image"], rows.schema["y"], T.StructField("labels", T.ArrayType(pixels.schema["label"].dataType))]
    schema = T.StructType(kinds)
    arrow = to_arrow_schema(schema)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.append(0, np.cumsum(width))
            out = np.full(int(starts[-1]), empty, np.int64)
            counts = batch.column("_at").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), counts)
            found = batch.column("_at").flatten()
            x, label = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "label"))
            inside = (x >= 0) & (x < width[row])
            out[starts[row[inside]] + x[inside]] = label[inside]
            labels = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(out)).cast(arrow.field("labels").type)
            yield pa.RecordBatch.from_arrays([batch.column("image"), batch.column("y"), labels], schema=arrow)

    return rows.mapInArrow(fill, schema)


def write_prediction_cache(cache: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Predictions in one folder per method."""
    _write_by_image(cache, folder, mode, ("method",))


def write_class_masks(masks: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Mask pixels in one folder per class."""
    _write_by_image(masks, folder, mode, ("class_id",))


def write_projection_stats(report: DataFrame, folder: str, mode: str = "overwrite") -> None:
    report.write.mode(mode).json(folder)


def nested_report(overall: DataFrame, per_class: DataFrame, binary: DataFrame) -> DataFrame:
    """One row per method: binary scores, overall class scores, and scores by class name.

    A method has as many class rows as there are classes, so its map stays small.
    """
    names = [c for c in per_class.columns if c not in ("method", "class_id", "class_name")]
    by_class = per_class.groupBy("method").agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct(F.col("class_name"), F.struct(*names))))
        ).alias("classes")
    )
    part = overall.select("method", F.struct(*[c for c in overall.columns if c != "method"]).alias("overall"))
    whole = binary.select("method", F.struct(*[c for c in binary.columns if c != "method"]).alias("binary"))
    return whole.join(part, "method", "full_outer").join(by_class, "method", "full_outer")


def write_reports(report: DataFrame, per_image: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Reports by method, and scores per image in the order of method, image and class."""
    write_ordered(report, f"{folder}/report", ["method"], mode=mode)
    write_ordered(per_image, f"{folder}/per_image", ["method", "image", "class_id"], mode=mode)


def upsert_summary(new: DataFrame, folder: str, previous: str | None = None) -> None:
    """Merge method rows into a summary and store it in a new folder.

    ``previous`` is the folder of the last summary; an absent one counts as
    empty, and lines that are not whole rows are left out.
    """
    merged = new
    if previous:
        try:
            bad = "_corrupt_record"
            schema = T.StructType([*new.schema.fields, T.StructField(bad, T.StringType())])
            old = new.sparkSession.read.schema(schema).option("columnNameOfCorruptRecord", bad).json(previous)
            old = old.filter(F.col(bad).isNull() & F.col("method").isNotNull()).drop(bad)
            merged = metrics.upsert(old, new)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    merged.write.mode("overwrite").json(folder)


def write_stability(subset: DataFrame, folder: str, names: Sequence[str] = ("precision", "recall", "iou")) -> None:
    """Chosen classes of each method with scores and counts, as nested JSON."""
    scores = F.struct(*names, F.struct("tp", "fp", "fn", "tn").alias("counts"))
    rows = subset.groupBy("method", "overall_mean_iou").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("class_id"), scores)))).alias("target_classes")
    )
    rows.write.mode("overwrite").json(folder)


def write_camera_list(cameras: DataFrame, folder: str) -> None:
    cameras.write.mode("overwrite").json(folder)
