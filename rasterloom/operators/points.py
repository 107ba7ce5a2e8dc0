"""Point-cloud cleaning and statistics.

A cloud is ``points(src_file, point_idx, x, y, z, class)``; ``point_idx`` is the
row's position in its file and settles every tie.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import labels

FOOT_TO_METRE = 0.3048


def translate(points: DataFrame, dx: float, dy: float, dz: float) -> DataFrame:
    """Add a shift, in double."""
    return points.withColumns(
        {axis: F.col(axis) + F.lit(float(d)) for axis, d in zip("xyz", (dx, dy, dz))}
    )


def frame_shift(points: DataFrame, shift: Sequence[float] | None) -> DataFrame:
    """Last translation into the scene frame; no shift leaves the points alone."""
    return points if shift is None else translate(points, *shift)


def affine(
    points: DataFrame,
    z_unit: float = FOOT_TO_METRE,
    scale: Sequence[float] = (1.0, 1.0, 1.0),
    shift: Sequence[float] = (0.0, 0.0, 0.0),
    extra_z: float = 0.0,
) -> DataFrame:
    """Height unit, then scale, then shift, then an extra height shift."""
    x = F.col("x") * F.lit(float(scale[0])) + F.lit(float(shift[0]))
    y = F.col("y") * F.lit(float(scale[1])) + F.lit(float(shift[1]))
    z = F.col("z") * F.lit(float(z_unit)) * F.lit(float(scale[2])) + F.lit(float(shift[2]))
    return points.withColumns({"x": x, "y": y, "z": z + F.lit(float(extra_z))})


def remap_classes(points: DataFrame, mapping: Mapping[int, int]) -> DataFrame:
    """Simultaneous class remap; classes without a rule stay."""
    return points.withColumn("class", labels.remap_simultaneous(F.col("class"), mapping))


def distance_to(center: Sequence[float | Column]) -> Column:
    """Euclidean distance of the row's x, y, z to a point."""
    d = [F.col(a) - (c if isinstance(c, Column) else F.lit(float(c))) for a, c in zip("xyz", center)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def filter_by_distance(
    points: DataFrame,
    center: Sequence[float | Column],
    min_distance: float | None = None,
    max_distance: float | None = None,
) -> DataFrame:
    """Keep points inside a distance range; both ends inclusive and optional."""
    if min_distance is not None:
        points = points.filter(distance_to(center) >= F.lit(float(min_distance)))
    if max_distance is not None:
        points = points.filter(distance_to(center) <= F.lit(float(max_distance)))
    return points


def class_histogram(df: DataFrame, by: Sequence[str] = (), label: str = "class") -> DataFrame:
    """Rows per class and their share, overall or per ``by`` group."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = counts.join(totals, list(by)) if by else counts.withColumn(
        "total", totals.select("total").scalar()
    )
    return joined.select(
        *by, label, "n", (F.col("n") / F.col("total") * F.lit(100.0)).alias("percent")
    )


def bounds(points: DataFrame) -> DataFrame:
    """Smallest and largest coordinate per axis, one row."""
    return points.agg(
        *[f(axis).alias(f"{name}_{axis}") for axis in "xyz" for f, name in ((F.min, "min"), (F.max, "max"))]
    )


def point_count(points: DataFrame) -> DataFrame:
    return points.groupBy("src_file").agg(F.count("*").alias("n_points"))


def retention_stats(original: DataFrame, kept: DataFrame) -> DataFrame:
    """Original and kept counts with their rate per file and class, per file and overall.

    Both sides are counted before the rollup, so its expansion touches one row per
    file and class and not every point. Overall rows have NULL file or class.
    """
    per_class = [
        df.groupBy("src_file", "class").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
        for side, df in enumerate((original, kept))
    ]
    counted = per_class[0].unionByName(per_class[1])

    def total(side: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0))

    return (
        counted.rollup("src_file", "class")
        .agg(total(0).alias("n_original"), total(1).alias("n_kept"))
        .withColumn(
            "rate",
            F.when(F.col("n_original") > 0, F.col("n_kept") / F.col("n_original")).otherwise(0.0),
        )
    )


def class_retention(original: DataFrame, kept: DataFrame) -> DataFrame:
    """Counts and percentage kept per class over all files."""
    marked = original.select("class", F.lit(1).alias("o"), F.lit(0).alias("k")).unionByName(
        kept.select("class", F.lit(0).alias("o"), F.lit(1).alias("k"))
    )
    return (
        marked.groupBy("class")
        .agg(F.sum("o").alias("n_original"), F.sum("k").alias("n_kept"))
        .withColumn(
            "percent",
            F.when(F.col("n_original") > 0, F.lit(100.0) * F.col("n_kept") / F.col("n_original")).otherwise(
                0.0
            ),
        )
    )
