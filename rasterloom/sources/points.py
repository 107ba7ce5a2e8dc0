"""Readers that give clouds and splats their canonical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources import records

POINT_COLUMNS = ("src_file", "point_idx", "x", "y", "z", "class")


def list_inputs(spark: SparkSession, spec: str, extensions: Sequence[str] = (".las", ".laz")) -> DataFrame:
    """Sorted (path, length) of a file, folder or glob with the given endings; none raises.

    Of a folder that a sink publishes by manifests, the files that the newest one names.
    """
    files = spark.read.format("binaryFile").load(spec).select("path", "length")
    newest = files.filter(F.col("path").rlike(r"/manifest-\d{9}\.json$")).agg(F.max("path")).first()[0]
    if newest is not None:
        # one entry per task that wrote
        named = spark.read.schema("folders array<string>, loose array<string>").json(newest).first()
        below = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(spec).select("path", "length")
        inner = F.substring(F.col("path"), newest.rindex("/") + 2, 1 << 20)
        task = F.regexp_extract(inner, "^(.*)/[^/]*$", 1)
        files = below.filter(F.when(task == "", inner.isin(named["loose"])).otherwise(task.isin(named["folders"])))
    keep = F.lit(False)
    for ending in extensions:
        keep = keep | F.lower("path").endswith(ending.lower())
    found = files.filter(keep)
    if found.isEmpty():
        raise FileNotFoundError(f"no {' or '.join(extensions)} files at {spec}")
    return found.orderBy("path")


def read_points(spark: SparkSession, path: str, kind: str = "parquet", class_field: str = "class") -> DataFrame:
    """Clouds from parquet, LAS or PLY as (src_file, point_idx, x, y, z, class).

    A field that is not there fails when the columns are resolved, and the error
    lists the fields there are. Parquet clouds carry their own point_idx.
    """
    if kind in ("las", "ply"):
        records.register(spark)
        cloud = spark.read.format(kind).load(path)
    elif kind == "parquet":
        cloud = spark.read.parquet(path)
        if "src_file" not in cloud.columns:
            # the whole path: files of one name in two folders stay apart
            cloud = cloud.withColumn("src_file", F.input_file_name())
    else:
        raise ValueError(f"unknown point format {kind!r}")
    return cloud.select(
        "src_file",
        F.col("point_idx").cast("long"),
        *[F.col(a).cast("double").alias(a) for a in "xyz"],
        F.col(class_field).cast("int").alias("class"),
    )


def count_points(spark: SparkSession, path: str, kind: str = "las") -> int:
    """Number of records as the headers state it; clouds without such headers are counted."""
    if kind in ("las", "ply"):
        return records.count_records(spark, path, kind)
    return read_points(spark, path, kind).count()


def read_colored(spark: SparkSession, path: str) -> DataFrame:
    """PLY with byte colours: positions, colours scaled to 0..1, normals."""
    records.register(spark)
    cloud = spark.read.format("ply").load(path)
    return cloud.select(
        "src_file",
        "point_idx",
        *[F.col(a).cast("double").alias(a) for a in "xyz"],
        *[(F.col(n) / F.lit(255.0)).alias(c) for n, c in (("red", "r"), ("green", "g"), ("blue", "b"))],
        *[F.col(n).cast("double").alias(n) for n in ("nx", "ny", "nz")],
    )


def read_splats(spark: SparkSession, path: str, degree: int = 3) -> DataFrame:
    """Splat PLY: numbered attributes gathered into arrays in numeric order.

    The number of higher colour terms must be the one ``degree`` calls for.
    """
    records.register(spark)
    table = spark.read.format("ply").load(path)

    def numbered(prefix: str) -> list[str]:
        names = [c for c in table.columns if c.startswith(prefix)]
        return sorted(names, key=lambda c: int(c.rsplit("_", 1)[1]))

    rest = numbered("f_rest_")
    if len(rest) != 3 * (degree + 1) ** 2 - 3:
        raise ValueError(f"{len(rest)} f_rest fields do not fit degree {degree}")

    def gathered(names: list[str]):
        if not names:
            return F.array().cast("array<float>")
        return F.array(*[F.col(n).cast("float") for n in names])

    return table.select(
        "src_file",
        "point_idx",
        "x",
        "y",
        "z",
        gathered(numbered("f_dc_")).alias("f_dc"),
        gathered(rest).alias("f_rest"),
        "opacity",
        gathered(numbered("scale_")).alias("scale"),
        gathered(numbered("rot_")).alias("rot"),
    )
