"""Structure-from-motion scenes: intrinsics, poses, sparse points, and pose JSON files.

A path may be a glob over many scenes; the ``scene`` column is the folder a file
lies in. Text points are split by line, binary poses and points by an index of
their records; other files are one unit of work.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.geometry import fov_to_focal, focal_to_fov
from rasterloom.functions.paths import stem
from rasterloom.operators.camera import resolve_cameras
from rasterloom.operators.ranking import numbered
from rasterloom.sources import indexed

# Model number, name and parameter count of the binary camera files.
CAMERA_MODELS = {
    0: ("SIMPLE_PINHOLE", 3),
    1: ("PINHOLE", 4),
    2: ("SIMPLE_RADIAL", 4),
    3: ("RADIAL", 5),
    4: ("OPENCV", 8),
    5: ("OPENCV_FISHEYE", 8),
    6: ("FULL_OPENCV", 12),
    7: ("FOV", 5),
    8: ("SIMPLE_RADIAL_FISHEYE", 4),
    9: ("RADIAL_FISHEYE", 5),
    10: ("THIN_PRISM_FISHEYE", 12),
}

CAMERA_SCHEMA = "scene string, camera_id int, model string, width int, height int, params array<double>"
IMAGE_SCHEMA = (
    "scene string, image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, "
    "obs array<struct<x:double,y:double,point3d_id:bigint>>"
)
POINT_SCHEMA = "scene string, id bigint, x double, y double, z double, r int, g int, b int, error double"


def scene_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").load(path)
    return found.select(scene_of(F.col("path")).alias("scene"), "content")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of each file in order, comments left out, as one array per file."""
    whole = spark.read.text(path, wholetext=True)
    parts = F.split(F.regexp_replace("value", r"\r", ""), "\n")
    return whole.select(
        scene_of(F.input_file_name()).alias("scene"),
        F.filter(parts, lambda line: ~line.startswith("#")).alias("lines"),
    )


def read_intrinsics_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id model width height params...``."""
    rows = _lines(spark, path).select("scene", F.explode("lines").alias("line")).filter(F.trim("line") != "")
    words = F.split(F.trim("line"), r"\s+")
    return rows.withColumn("w", words).select(
        "scene",
        F.col("w")[0].cast("int").alias("camera_id"),
        F.col("w")[1].alias("model"),
        F.col("w")[2].cast("int").alias("width"),
        F.col("w")[3].cast("int").alias("height"),
        F.transform(F.slice("w", 5, F.size("w") - 4), lambda v: v.cast("double")).alias("params"),
    )


def read_intrinsics_binary(spark: SparkSession, path: str) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for scene, data in zip(batch["scene"], batch["content"]):
                rows, at = [], 8
                for _ in range(struct.unpack_from("<Q", data)[0]):
                    camera_id, model, width, height = struct.unpack_from("<iiQQ", data, at)
                    name, n = CAMERA_MODELS[model]
                    params = struct.unpack_from(f"<{n}d", data, at + 24)
                    rows.append((scene, camera_id, name, width, height, list(params)))
                    at += 24 + 8 * n
                yield pd.DataFrame(rows, columns=["scene", "camera_id", "model", "width", "height", "params"])

    return _files(spark, path).mapInPandas(parse, CAMERA_SCHEMA)


def read_poses_text(spark: SparkSession, path: str) -> DataFrame:
    """Two lines per image: the pose, then its observations (possibly none)."""
    files = _lines(spark, path)
    # the pose lines are the even ones; a final empty line belongs to no image
    pairs = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size("lines") / F.lit(2)).cast("int") - 1),
        lambda i: F.struct(
            F.get("lines", i * 2).alias("pose"), F.coalesce(F.get("lines", i * 2 + 1), F.lit("")).alias("seen")
        ),
    )
    rows = files.filter(F.size("lines") > 0).select("scene", F.explode(pairs).alias("p")).filter(F.trim("p.pose") != "")
    rows = rows.select(
        "scene", F.split(F.trim("p.pose"), r"\s+", 10).alias("w"), F.split(F.trim("p.seen"), r"\s+").alias("o")
    )
    seen = F.transform(
        F.when(F.size("o") >= 3, F.sequence(F.lit(0), F.floor(F.size("o") / F.lit(3)).cast("int") - 1)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.struct(
            F.get("o", i * 3).cast("double").alias("x"),
            F.get("o", i * 3 + 1).cast("double").alias("y"),
            F.get("o", i * 3 + 2).cast("bigint").alias("point3d_id"),
        ),
    )

    def numbers(start: int, n: int) -> Column:
        return F.transform(F.slice("w", start, n), lambda v: v.cast("double"))

    return rows.select(
        "scene",
        F.col("w")[0].cast("int").alias("image_id"),
        numbers(2, 4).alias("qvec"),
        numbers(6, 3).alias("tvec"),
        F.col("w")[8].cast("int").alias("camera_id"),
        F.col("w")[9].alias("name"),
        seen.alias("obs"),
    )


_POSE = np.dtype([("id", "<i4"), ("q", "<f8", 4), ("t", "<f8", 3), ("camera_id", "<i4")])
_SEEN = np.dtype([("x", "<f8"), ("y", "<f8"), ("point3d_id", "<i8")])
_POINT = np.dtype([("id", "<u8"), ("xyz", "<f8", 3), ("rgb", "u1", 3), ("error", "<f8"), ("track", "<u8")])


def _pose_length(data: bytes, at: int) -> int | None:
    """A pose, a name that ends in a zero byte, a count, and as many observations."""
    end = data.find(b"\0", at + _POSE.itemsize)
    if end < 0 or end + 9 > len(data):
        return None
    return end + 9 - at + _SEEN.itemsize * struct.unpack_from("<Q", data, end + 1)[0]


def _point_length(data: bytes, at: int) -> int | None:
    """Fixed fields, the last of which counts the entries of eight bytes behind them."""
    if at + _POINT.itemsize > len(data):
        return None
    return _POINT.itemsize + 8 * struct.unpack_from("<Q", data, at + 43)[0]


def _poses(data: bytes, starts: np.ndarray) -> pa.RecordBatch:
    pose = indexed.fields_at(data, starts, _POSE)
    ends = [data.index(b"\0", at + _POSE.itemsize) for at in starts.tolist()]
    names = [data[at + _POSE.itemsize : end].decode("utf-8") for at, end in zip(starts.tolist(), ends)]
    seen = np.array(ends, np.int64) + 1
    counts = indexed.fields_at(data, seen, np.dtype("<u8")).astype(np.int64)
    columns = {
        "image_id": pose["id"],
        "qvec": pa.FixedSizeListArray.from_arrays(pose["q"].ravel(), 4).cast(pa.list_(pa.float64())),
        "tvec": pa.FixedSizeListArray.from_arrays(pose["t"].ravel(), 3).cast(pa.list_(pa.float64())),
        "camera_id": pose["camera_id"],
        "name": names,
        "obs": indexed.lists_of(data, seen + 8, counts, _SEEN),
    }
    return pa.RecordBatch.from_pydict(columns)


def _points(data: bytes, starts: np.ndarray) -> pa.RecordBatch:
    point = indexed.fields_at(data, starts, _POINT)
    columns = {"id": point["id"].astype(np.int64)}
    columns |= {a: point["xyz"][:, i] for i, a in enumerate("xyz")}
    columns |= {c: point["rgb"][:, i].astype(np.int32) for i, c in enumerate("rgb")}
    return pa.RecordBatch.from_pydict(columns | {"error": point["error"]})


def _read_indexed(spark: SparkSession, path: str, length, decode, schema: str, every: int) -> DataFrame:
    index = indexed.index_files(spark, path, length, every)
    rows = indexed.read_ranges(index, length, decode, schema.removeprefix("scene string, "))
    return rows.select(scene_of(F.col("path")).alias("scene"), *rows.columns[1:])


def read_poses_binary(spark: SparkSession, path: str, every: int = 2000) -> DataFrame:
    """Images with all their observations; a file is read in ranges of ``every`` images by several tasks."""
    return _read_indexed(spark, path, _pose_length, _poses, IMAGE_SCHEMA, every)


def read_points3d_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id x y z r g b error track...``; tracks are skipped."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    w = F.split(F.trim("value"), r"\s+", 9)
    return lines.select(scene_of(F.input_file_name()).alias("scene"), w.alias("w")).select(
        "scene",
        F.col("w")[0].cast("bigint").alias("id"),
        *[F.col("w")[i + 1].cast("double").alias(a) for i, a in enumerate("xyz")],
        *[F.col("w")[i + 4].cast("int").alias(c) for i, c in enumerate("rgb")],
        F.col("w")[7].cast("double").alias("error"),
    )


def read_points3d_binary(spark: SparkSession, path: str, every: int = indexed.RANGE_RECORDS) -> DataFrame:
    """Points without their tracks; a file is read in ranges of ``every`` points by several tasks."""
    return _read_indexed(spark, path, _point_length, _points, POINT_SCHEMA, every)


def _exists(spark: SparkSession, pattern: str) -> bool:
    try:
        return not spark.read.format("binaryFile").load(pattern).select("path").isEmpty()
    except Exception as error:  # Spark reports a missing path as an analysis error
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def read_scene(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(poses, intrinsics) of a scene folder; binary files are preferred to text."""
    if _exists(spark, f"{folder}/cameras.bin") and _exists(spark, f"{folder}/images.bin"):
        return read_poses_binary(spark, f"{folder}/images.bin"), read_intrinsics_binary(spark, f"{folder}/cameras.bin")
    if _exists(spark, f"{folder}/cameras.txt") and _exists(spark, f"{folder}/images.txt"):
        return read_poses_text(spark, f"{folder}/images.txt"), read_intrinsics_text(spark, f"{folder}/cameras.txt")
    raise FileNotFoundError(f"no cameras and images files in {folder}")


def load_cameras(
    spark: SparkSession, folder: str, target_width: int | None = None, target_height: int | None = None
) -> DataFrame:
    """Resolved pinhole cameras of a scene, optionally for another image size."""
    return resolve_cameras(*read_scene(spark, folder), target_width, target_height)


def read_transform_cameras(
    spark: SparkSession, path: str, width: int, height: int, extension: str = ".png", lines: bool = False
) -> DataFrame:
    """Cameras of a pose JSON file (camera_angle_x and frames with 4x4 matrices).

    The matrices go from camera to world with y up and z back. Flipping those two
    axes and inverting the rigid motion gives world to camera. The file does not
    state the image size, so the caller does. ``uid`` is the place of a frame.

    With ``lines`` each line is such an object with some of the frames, and lines
    are read by many tasks; frames are then numbered in the order of their paths.
    """
    schema = "camera_angle_x double, frames array<struct<file_path:string,transform_matrix:array<array<double>>>>"
    frames = (
        spark.read.schema(schema)
        .option("multiLine", not lines)
        .json(path)
        .select("camera_angle_x", F.posexplode("frames").alias("uid", "f"))
    )
    if lines:
        frames = numbered(frames.drop("uid").withColumn("_path", F.col("f.file_path")), ["_path"], "uid")
    m = F.col("f.transform_matrix")

    def c2w(row: int, column: int) -> Column:
        return m[row][column] * F.lit(-1.0 if column in (1, 2) else 1.0)

    rotation = {f"r{i}{j}": c2w(j, i) for i in range(3) for j in range(3)}
    shift = {
        f"t{i}": -(c2w(0, i) * m[0][3] + c2w(1, i) * m[1][3] + c2w(2, i) * m[2][3]) for i in range(3)
    }
    focal = fov_to_focal(F.col("camera_angle_x"), F.lit(float(width)))
    file = F.concat(F.col("f.file_path"), F.lit(extension))
    return frames.select(
        "uid",
        stem(file).alias("image"),
        file.alias("path"),
        F.lit(int(width)).alias("width"),
        F.lit(int(height)).alias("height"),
        focal.alias("fx"),
        focal.alias("fy"),
        F.lit(width / 2.0).alias("cx"),
        F.lit(height / 2.0).alias("cy"),
        F.col("camera_angle_x").alias("fov_x"),
        focal_to_fov(focal, F.lit(float(height))).alias("fov_y"),
        *[c.alias(n) for n, c in {**rotation, **shift}.items()],
    )
