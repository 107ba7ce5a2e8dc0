"""Dense raster files as pixel tables. Arrays are read line by line, pictures file by file."""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rasterloom.functions.paths import stem
from rasterloom.sources import records

_ROWS = 200_000
# endings of pictures, in no particular order of preference
PICTURE_ENDINGS = (".png", ".jpg", ".jpeg", ".PNG", ".JPG", ".JPEG")


def _arrays(spark: SparkSession, path: str, ending: str = "*.npy") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", ending).load(path)
    return files.select(stem(F.col("path")).alias("image"), "path", "content")


def _load(content: bytes) -> np.ndarray:
    return np.load(io.BytesIO(content), allow_pickle=False)


def _block_of(name: Column) -> tuple[Column, Column]:
    """Image name and first row of a file that holds all or a block of its image's rows."""
    parts = r"^(.*)\.rows-(\d{9})$"
    block = name.rlike(parts)
    return (
        F.when(block, F.regexp_extract(name, parts, 1)).otherwise(name),
        F.when(block, F.regexp_extract(name, parts, 2).cast("long")).otherwise(F.lit(0)),
    )


def _array_lines(spark: SparkSession, path: str, axes: int, ending: str = ".npy") -> DataFrame:
    """(image, line_no, shape, kind, line) of array files; a large file is read by several tasks."""
    records.register(spark)
    lines = spark.read.format("npy").option("axes", axes).option("ending", ending).load(path)
    image, first = _block_of(stem(F.col("src_file")))
    return lines.select(image.alias("image"), (F.col("point_idx") + first).alias("line_no"), "shape", "kind", "line")


def _line_blocks(
    batches: Iterator[pa.RecordBatch], dtype: type
) -> Iterator[tuple[pa.Array, np.ndarray, list[int], np.ndarray]]:
    """(images, line numbers, shape, values with a row a line) of neighbouring lines of one shape, about _ROWS values at once."""
    for batch in batches:
        shapes, kinds, lines = (batch.column(c).to_pylist() for c in ("shape", "kind", "line"))
        numbers = batch.column("line_no").to_numpy()
        low = 0
        for (shape, kind, size), run in groupby(zip(shapes, kinds, map(len, lines))):
            high = low + len(list(run))
            step = max(1, _ROWS * np.dtype(kind).itemsize // max(size, 1))
            for first in range(low, high, step):
                last = min(first + step, high)
                values = np.frombuffer(b"".join(lines[first:last]), np.dtype(kind)).astype(dtype)
                image = batch.column("image").slice(first, last - first)
                yield image, numbers[first:last], shape, values.reshape(last - first, -1)
            low = high


def _record_batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def read_label_rasters(spark: SparkSession, path: str, lowest_valid: int = 0) -> DataFrame:
    """Label arrays as sparse pixels; values below ``lowest_valid`` mean no label."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image, number, _, values in _line_blocks(batches, np.int32):
            line, x = np.nonzero(values >= lowest_valid)
            columns = [image.take(pa.array(line)), number[line], x, values[line, x]]
            yield _record_batch(columns, arrow)

    schema = "image string, y int, x int, label int"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    return _array_lines(spark, path, 1).mapInArrow(explode, schema)


def read_raster_dims(spark: SparkSession, path: str) -> DataFrame:
    """Height and width of every array, from the headers alone; blocks of one image count together."""
    image, first = _block_of(stem(F.col("path")))
    return (
        records.read_shapes(spark, path)
        .groupBy(image.alias("image"))
        .agg(
            F.min("path").alias("path"),
            F.max(first + F.col("shape")[0]).cast("int").alias("height"),
            F.max(F.col("shape")[1]).alias("width"),
            F.max(F.size("shape")).alias("axes"),
        )
    )


def detect_resolution(spark: SparkSession, path: str) -> DataFrame:
    """Size of the first three-dimensional feature file by path, one row."""
    dims = read_raster_dims(spark, path)
    first = dims.agg(F.min_by(F.struct("height", "width", "axes", "path"), "path").alias("f"))
    wrong = F.raise_error(F.concat(F.lit("expected a (height, width, channels) array: "), F.col("f.path")))
    none = F.raise_error(F.lit("no feature files to take the size from"))
    height = F.when(F.col("f").isNull(), none.cast("int")).when(F.col("f.axes") != 3, wrong.cast("int")).otherwise(F.col("f.height"))
    return first.select(height.alias("height"), F.col("f.width").alias("width"))


def read_feature_rasters(spark: SparkSession, path: str) -> DataFrame:
    """(height, width, channels) arrays as one feature vector per pixel."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image, number, shape, values in _line_blocks(batches, np.float32):
            width, channels = shape[1], shape[2]
            flat = values.reshape(len(values) * width, channels)
            step = max(1, _ROWS // max(channels, 1))
            for low in range(0, len(flat), step):
                part = flat[low : low + step]
                line, x = np.divmod(np.arange(low, low + len(part)), width)
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * np.int32(channels))
                feature = pa.ListArray.from_arrays(offsets, pa.array(part.reshape(-1)))
                yield _record_batch([image.take(pa.array(line)), number[line], x, feature], arrow)

    schema = "image string, y int, x int, feature array<float>"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    return _array_lines(spark, path, 2).mapInArrow(explode, schema)


def _plain(path: Column) -> Column:
    """One spelling of a path: sources differ in the slashes after ``file:``."""
    return F.regexp_replace(path, "^file:/+", "/")


def _picture_files(spark: SparkSession, path: str) -> DataFrame:
    """The picture files of a folder, with contents that are read only if asked for."""
    files = spark.read.format("binaryFile").load(path)
    return files.filter(F.col("path").rlike(r"(?i)\.(png|jpe?g)$"))


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pictures of any known ending, one per stem (the first by path).

    A picture that cannot be decoded is an error that names it. The files are
    chosen from their names, so every picture is decoded once.
    """
    pictures = spark.read.format("image").option("dropInvalid", False).load(path)
    origin = F.col("image.origin")
    broken = F.raise_error(F.concat(F.lit("cannot decode picture "), origin)).cast("int")
    kept = pictures.filter(origin.rlike(r"(?i)\.(png|jpe?g)$")).select(
        stem(origin).alias("image"),
        origin.alias("path"),
        _plain(origin).alias("_file"),
        F.when(F.col("image.height") < 1, broken).otherwise(F.col("image.height")).alias("height"),
        *[F.col(f"image.{n}").alias(n) for n in ("width", "nChannels", "data")],
    )
    files = _picture_files(spark, path).select(stem(F.col("path")).alias("image"), _plain(F.col("path")).alias("_file"))
    first = files.groupBy("image").agg(F.min("_file").alias("_file")).select("_file")
    return kept.join(first, "_file", "left_semi").drop("_file")


def picture_pixels(pictures: DataFrame) -> DataFrame:
    """Pixels with r, g, b; the decoder stores channels in reverse order."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image, height, width, channels, data in zip(
                batch["image"], batch["height"], batch["width"], batch["nChannels"], batch["data"]
            ):
                flat = np.frombuffer(data, dtype=np.uint8).reshape(-1, channels)
                for low in range(0, len(flat), _ROWS):
                    part = flat[low : low + _ROWS].astype(np.int16)
                    at = np.arange(low, low + len(part))
                    red = part[:, 2] if channels >= 3 else part[:, 0]
                    yield pd.DataFrame(
                        {
                            "image": image,
                            "y": (at // width).astype(np.int32),
                            "x": (at % width).astype(np.int32),
                            "r": red,
                            "g": part[:, 1] if channels >= 3 else red,
                            "b": part[:, 0],
                        }
                    )

    columns = pictures.select("image", "height", "width", "nChannels", "data")
    return columns.mapInPandas(explode, "image string, y int, x int, r smallint, g smallint, b smallint")


def read_instance_rasters(spark: SparkSession, path: str) -> DataFrame:
    """8-bit id pictures as instance pixels: the first stored channel is the id.

    The picture decoder brings every depth down to 8 bits, so a file whose header
    states another one is an error; wider ids come as parquet, or as arrays
    through ``read_label_rasters``.
    """
    pictures = read_pictures(spark, path)
    # a PNG states its depth in byte 25; the other kinds here always have 8 bits
    depth = F.conv(F.hex(F.substring("content", 25, 1)), 16, 10).cast("int")
    heads = _picture_files(spark, path).select(
        _plain(F.col("path")).alias("_file"),
        F.when(F.lower("path").endswith(".png"), depth).otherwise(F.lit(8)).alias("_depth"),
    )
    wrong = F.concat(
        F.lit("instance ids need an 8-bit picture, or an array for wider ids: "), F.col("path"), F.lit(" has "), F.col("_depth"), F.lit(" bits")
    )
    checked = pictures.withColumn("_file", _plain(F.col("path"))).join(heads, "_file")
    checked = checked.withColumn(
        "height", F.when(F.col("_depth") != 8, F.raise_error(wrong).cast("int")).otherwise(F.col("height"))
    )
    pixels = picture_pixels(checked)
    return pixels.select("image", "y", "x", F.col("b").cast("int").alias("instance_id"))


def read_instance_features(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, feature) rows from array files.

    An archive holds ``features`` with ``instance_ids`` or ``ids``; a plain matrix
    has the id as its row number (see ``usable_features`` for its empty rows).
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                loaded = _load(content)
                if isinstance(loaded, np.ndarray):
                    matrix, ids = loaded.astype(np.float32), np.arange(len(loaded))
                else:
                    key = "instance_ids" if "instance_ids" in loaded.files else "ids"
                    matrix, ids = loaded["features"].astype(np.float32), loaded[key]
                for low in range(0, len(matrix), 10_000):
                    part = slice(low, low + 10_000)
                    yield pd.DataFrame({"instance_id": ids[part].astype(np.int32), "feature": list(matrix[part])})

    return _arrays(spark, path, "*.np[yz]").mapInPandas(explode, "instance_id int, feature array<float>")


def read_language_features(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Segment ids per level and pixel, and the features of each image's segments.

    Files are ``<image>_s.npy`` with (levels, height, width) ids and
    ``<image>_f.npy`` with one feature row per segment.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image, number, shape, values in _line_blocks(batches, np.int32):
            line, x = np.divmod(np.arange(values.size), values.shape[1])
            level, y = np.divmod(number[line], shape[1])
            name = pc.utf8_slice_codeunits(image, 0, -len("_s"))
            yield _record_batch([name.take(pa.array(line)), level, y, x, values.reshape(-1)], arrow)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            feature = [np.frombuffer(v, np.dtype(k)).astype(np.float32) for k, v in zip(batch["kind"], batch["line"])]
            yield pd.DataFrame(
                {
                    "image": [i[: -len("_f")] for i in batch["image"]],
                    "seg": batch["line_no"].astype(np.int32),
                    "feature": feature,
                }
            )

    schema = "image string, level int, y int, x int, seg int"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    return (
        _array_lines(spark, folder, 1, "_s.npy").mapInArrow(segments, schema),
        _array_lines(spark, folder, 1, "_f.npy").mapInPandas(vectors, "image string, seg int, feature array<float>"),
    )


def read_prediction_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Cached predictions of all methods; ``method`` is a partition column."""
    return spark.read.parquet(folder).drop("image_bucket")
