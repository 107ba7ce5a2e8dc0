"""JSON files that steer a run: class names, colours, maps, rates, frames, entities.

A file is one JSON object and small. Class names and entities may be many: with
``lines`` each line is an object with some of the entries, and lines are read by
many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(spark: SparkSession, path: str, lines: bool = False) -> DataFrame | None:
    """The whole file as one row, or a row per line, or None where there is no file."""
    try:
        return spark.read.text(path, wholetext=not lines)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def _document(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    """The file's JSON object, or one object per line, as (key, value) rows; a missing file gives none."""
    whole = _text(spark, path, lines)
    if whole is None:
        return spark.createDataFrame([], f"key string, value {kind}")
    return whole.select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias("key", "value"))


def read_int_map(spark: SparkSession, path: str, kind: str = "int", lines: bool = False) -> DataFrame:
    """(key, value) of a JSON object with integer keys; keys with a leading _ are notes."""
    return _document(spark, path, kind, lines).filter(~F.col("key").startswith("_")).select(
        F.col("key").cast("int").alias("key"), "value"
    )


def read_retention(spark: SparkSession, path: str) -> dict[int, float]:
    """Retention rate per class. Notes may hold any JSON, so values are read as text first."""
    rows = read_int_map(spark, path, "string").select("key", F.col("value").cast("double").alias("value"))
    return {r["key"]: r["value"] for r in rows.collect()}


def read_class_prompts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(class_id, prompts) where a class has one text or a list; the first is its name."""
    texts = read_int_map(spark, path, "string", lines)
    listed = F.from_json("value", "array<string>")
    is_list = F.trim("value").startswith("[")
    return texts.select(
        F.col("key").alias("class_id"), F.when(is_list, listed).otherwise(F.array("value")).alias("prompts")
    )


def read_merge_map(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Target to sources, in the order of the file (the merges are ordered); a missing file merges nothing."""
    whole = _text(spark, path)
    if whole is None:
        return {}
    entries = F.from_json("value", "map<string,array<int>>")
    rows = whole.select(F.posexplode(F.map_entries(entries)).alias("i", "e")).orderBy("i").select("e.*")
    return {int(r["key"]): list(r["value"]) for r in rows.collect()}


def read_colors(spark: SparkSession, path: str) -> dict[int, tuple[int, ...]]:
    rows = read_int_map(spark, path, "array<int>")
    return {r["key"]: tuple(r["value"]) for r in rows.collect()}


def read_frame_shift(spark: SparkSession, path: str) -> tuple[float, float, float]:
    """The shift into the scene frame; its scale and axis swap are not used."""
    shift: Column = F.col("base_to_canonical.shift")
    schema = "base_to_canonical struct<shift:array<double>>"
    row = spark.read.schema(schema).option("multiLine", True).json(path).select(shift.alias("s")).first()
    return tuple(row["s"])


def read_entities(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(entity_id, type, parent_id) of a JSON object of typed entities."""
    return _document(spark, path, "struct<type:string,parent:string>", lines).select(
        F.col("key").alias("entity_id"),
        F.coalesce("value.type", F.lit("")).alias("type"),
        F.col("value.parent").alias("parent_id"),
    )


def read_instance_entity(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, entity_id) of a JSON object."""
    return read_int_map(spark, path, "string").select(
        F.col("key").alias("instance_id"), F.col("value").alias("entity_id")
    )
