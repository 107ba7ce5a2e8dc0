"""From a labelled cloud and cameras to per-camera label rasters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import colors
from rasterloom.operators import camera, neighborhood, points


@dataclass(frozen=True)
class ProjectionConfig:
    min_depth: float = 0.01
    max_depth: float = 1000.0
    fill: str = "none"
    fill_radius: int = 10
    edge_threshold: float = 0.05


def near_camera(
    cloud: DataFrame,
    cameras: DataFrame,
    name: str,
    min_distance: float | None = None,
    max_distance: float | None = None,
) -> DataFrame:
    """Points within a distance range of one named camera; an unknown name raises."""
    named = cameras.withColumn("image", F.col("image").cast("string"))
    wanted = cloud.sparkSession.createDataFrame([(name,)], "name string")
    found = camera.with_center(camera.find_camera(named, wanted))
    center = found.agg(
        F.first(F.struct("center_x", "center_y", "center_z")).alias("c")
    ).select("c").scalar()
    placed = cloud.withColumn("_c", center)
    parts = [F.col(f"_c.center_{a}") for a in "xyz"]
    return points.filter_by_distance(placed, parts, min_distance, max_distance).drop("_c")


def project_cloud(cloud: DataFrame, cameras: DataFrame, config: ProjectionConfig = ProjectionConfig()) -> DataFrame:
    """Label rasters of all cameras: pixels(image, y, x, label, filled)."""
    hits = camera.project_points(cloud, cameras, config.min_depth, config.max_depth)
    nearest = camera.zbuffer(hits)
    dims = cameras.select("image", "height", "width")
    return neighborhood.fill_holes(nearest, dims, config.fill, config.fill_radius, config.edge_threshold)


def projection_stats(filled: DataFrame, cameras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coverage before and after filling per image, and the class counts per image."""
    counts = filled.groupBy("image").agg(
        F.count_if(~F.col("filled")).alias("before"), F.count("*").alias("after")
    )
    size = F.col("width").cast("double") * F.col("height")
    per_image = cameras.select("image", "width", "height").join(counts, "image", "left").select(
        "image",
        (F.coalesce("before", F.lit(0)) / size).alias("coverage_before"),
        (F.coalesce("after", F.lit(0)) / size).alias("coverage_after"),
    )
    return per_image, filled.groupBy("image", "label").agg(F.count("*").alias("n"))


def color_table(filled: DataFrame, configured: Mapping[int, Sequence[int]] | None = None) -> DataFrame:
    """Colour of every class that occurs, and black for no label."""
    found = filled.select("label").distinct()
    shown = found.select("label", colors.palette_color(F.col("label"), configured or {}).alias("color"))
    none = filled.sparkSession.createDataFrame([(-1, [0, 0, 0])], "label int, color array<int>")
    return shown.unionByName(none)


def projection_report(filled: DataFrame, cameras: DataFrame, method: str) -> DataFrame:
    """One row per image with its class counts, next to the averages over all images."""
    per_image, classes = projection_stats(filled, cameras)
    lists = classes.groupBy("image").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("label"), F.col("n"))))).alias("classes")
    )
    means = per_image.agg(
        F.struct(
            F.count("*").alias("total_images"),
            F.avg("coverage_before").alias("average_coverage_before"),
            F.avg("coverage_after").alias("average_coverage_after"),
        ).alias("m")
    ).select("m").scalar()
    return (
        per_image.join(lists, "image", "left")
        .withColumns({"fill_method": F.lit(method), "_m": means})
        .select("*", "_m.*")
        .drop("_m")
    )
