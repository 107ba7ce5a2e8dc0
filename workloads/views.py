"""Domain tables derived from the given tables, for Spark and as SQL text.

The arithmetic uses integers and doubles only, so both engines get the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workloads.registry import table

CLASS_IDS = (1, 2, 3, 12, 101, 103, 104)
POSITIVE_IDS = (1, 2, 3, 12)
NEGATIVE_IDS = (101, 103, 104)
RASTER_WIDTH = 20

RASTER_SQL = """
p AS (
  SELECT CAST(o_orderkey % 5 AS INT) AS image,
         CAST(floor(o_orderkey / 1e2) AS INT) AS y,
         CAST(floor((o_orderkey % 100) / 5e0) AS INT) AS x,
         CAST(o_custkey AS BIGINT) AS k, o_orderstatus AS s
  FROM orders),
b AS (SELECT *, CAST((floor(x / 7e0) + floor(y / 6e0) + image) % 5 AS INT) AS g FROM p),
v_raster AS (
SELECT image, y, x,
  CASE WHEN k % 13 = 0 THEN -1 WHEN g = 0 THEN 1 WHEN g = 1 THEN 2 WHEN g = 2 THEN 3 WHEN g = 3 THEN 12 ELSE 5 END AS primary_label,
  CASE WHEN k % 3 = 0 THEN -1 WHEN s = 'O' THEN 101 WHEN s = 'F' THEN 103 ELSE 102 END AS secondary_label,
  CASE WHEN k % 17 = 0 THEN -1 WHEN k % 11 = 0 THEN 104 WHEN k % 5 = 0 THEN 101
       WHEN g = 0 THEN 1 WHEN g = 1 THEN 2 WHEN g = 2 THEN 12 WHEN g = 3 THEN 12 ELSE 103 END AS pred_label
FROM b)"""

FUSED_SQL = RASTER_SQL + """,
fused AS (
  SELECT image, y, x,
    CASE WHEN primary_label IN (1, 2, 3, 12, 101, 103, 104) THEN primary_label
         WHEN secondary_label IN (1, 2, 3, 12, 101, 103, 104) THEN secondary_label END AS gt,
    CASE WHEN pred_label >= 0 THEN pred_label END AS pred
  FROM v_raster),
scored AS (SELECT * FROM fused WHERE gt IS NOT NULL)"""

POINTS_SQL = """
v_points AS (
SELECT concat('f', CAST(o_orderkey % 3 AS STRING)) AS src_file,
       o_orderkey AS point_idx,
       ((o_orderkey * 37) % 997) / 1e1 - 20e0 AS x,
       ((o_custkey * 53) % 499) / 1e1 - 20e0 AS y,
       ((o_orderkey * 17) % 251) / 1e1 AS z,
       CAST(substr(o_orderpriority, 1, 1) AS INT) AS class
FROM orders)"""

CAMERAS_SQL = """
v_cameras AS (
SELECT CAST(s_suppkey AS INT) AS camera_id, 60e0 + s_suppkey AS fx, 60e0 + s_suppkey AS fy,
       32e0 AS cx, 24e0 AS cy, 64 AS width, 48 AS height,
       CASE WHEN s_suppkey % 2 = 0 THEN 1e0 ELSE 0e0 END AS r00,
       CASE WHEN s_suppkey % 2 = 0 THEN 0e0 ELSE -1e0 END AS r01, 0e0 AS r02,
       CASE WHEN s_suppkey % 2 = 0 THEN 0e0 ELSE 1e0 END AS r10,
       CASE WHEN s_suppkey % 2 = 0 THEN 1e0 ELSE 0e0 END AS r11, 0e0 AS r12,
       0e0 AS r20, 0e0 AS r21, 1e0 AS r22,
       s_suppkey * 1e0 - 5e0 AS t0, -3e0 AS t1, 5e0 AS t2
FROM supplier)"""

INSTANCES_SQL = """
v_instances AS (
SELECT CAST(o_orderkey % 5 AS INT) AS image,
       CAST(floor(o_orderkey / 1e2) AS INT) AS y,
       CAST(floor((o_orderkey % 100) / 5e0) AS INT) AS x,
       CAST(floor(floor((o_orderkey % 100) / 5e0) / 4e0) + 5 * floor(o_orderkey / 1e3) AS INT) AS instance_id,
       CASE WHEN (o_custkey + CAST(floor((o_orderkey % 100) / 2e1) AS BIGINT)) % 4 < 3 THEN 1 ELSE 0 END AS mask
FROM orders)"""

BOXES_SQL = """
v_boxes AS (
SELECT CAST(s_suppkey % 5 AS INT) AS image, CAST(s_nationkey % 3 AS INT) AS prompt_idx,
       CASE WHEN s_nationkey % 3 = 0 THEN 101 WHEN s_nationkey % 3 = 1 THEN 103 ELSE 104 END AS class_id,
       CAST(s_suppkey AS INT) AS box_idx,
       ((s_suppkey * 7) % 15) * 1e0 AS x1, ((s_suppkey * 3) % 20) * 1e0 AS y1,
       ((s_suppkey * 7) % 15) + 45e-1 AS x2, ((s_suppkey * 3) % 20) + 125e-1 AS y2,
       (s_suppkey % 9 + 1) / 1e1 AS score
FROM supplier)"""

ENTITIES_SQL = """
v_entities AS (
SELECT concat('R', CAST(r_regionkey AS STRING)) AS entity_id, 'Building' AS type, CAST(NULL AS STRING) AS parent_id FROM region
UNION ALL
SELECT concat('N', CAST(n_nationkey AS STRING)),
       CASE WHEN n_nationkey % 4 = 0 THEN 'WallSurface' WHEN n_nationkey % 4 = 1 THEN 'RoofSurface' WHEN n_nationkey % 4 = 2 THEN 'Window' ELSE 'Installation' END,
       concat('R', CAST(n_regionkey AS STRING)) FROM nation
UNION ALL
SELECT concat('C', CAST(c_custkey AS STRING)), 'Part', concat('N', CAST(c_nationkey AS STRING)) FROM customer)"""


def _choose(*rules, otherwise):
    out = None
    for condition, value in rules:
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def _pixel_columns() -> dict:
    key = F.col("o_orderkey")
    return {
        "image": (key % 5).cast("int"),
        "y": F.floor(key / F.lit(100.0)).cast("int"),
        "x": F.floor((key % 100) / F.lit(5.0)).cast("int"),
    }


def raster(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    k, s = F.col("o_custkey").cast("long"), F.col("o_orderstatus")
    g = ((F.floor(F.col("x") / F.lit(7.0)) + F.floor(F.col("y") / F.lit(6.0)) + F.col("image")) % 5).cast("int")
    base = orders.withColumns(_pixel_columns()).withColumns({"k": k, "s": s}).withColumn("g", g)
    k, s, g = F.col("k"), F.col("s"), F.col("g")
    return base.select(
        "image",
        "y",
        "x",
        _choose((k % 13 == 0, -1), (g == 0, 1), (g == 1, 2), (g == 2, 3), (g == 3, 12), otherwise=5).alias(
            "primary_label"
        ),
        _choose((k % 3 == 0, -1), (s == "O", 101), (s == "F", 103), otherwise=102).alias("secondary_label"),
        _choose(
            (k % 17 == 0, -1),
            (k % 11 == 0, 104),
            (k % 5 == 0, 101),
            (g == 0, 1),
            (g == 1, 2),
            (g == 2, 12),
            (g == 3, 12),
            otherwise=103,
        ).alias("pred_label"),
    )


def layer(rasters: DataFrame, name: str) -> DataFrame:
    """One label layer of the raster table, in sparse form."""
    return rasters.select("image", "y", "x", F.col(f"{name}_label").alias("label")).filter(F.col("label") >= 0)


def raster_dims(rasters: DataFrame) -> DataFrame:
    """Image sizes: the width is fixed, the height follows the rows present."""
    return rasters.groupBy("image").agg((F.max("y") + 1).alias("height")).withColumn(
        "width", F.lit(RASTER_WIDTH)
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        F.concat(F.lit("f"), (key % 3).cast("string")).alias("src_file"),
        key.alias("point_idx"),
        (((key * 37) % 997) / F.lit(10.0) - F.lit(20.0)).alias("x"),
        (((cust * 53) % 499) / F.lit(10.0) - F.lit(20.0)).alias("y"),
        (((key * 17) % 251) / F.lit(10.0)).alias("z"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("class"),
    )


def cameras(spark: SparkSession, folder: str) -> DataFrame:
    """One camera per supplier; ``image`` is the camera number."""
    key = F.col("s_suppkey")
    even = key % 2 == 0
    one, zero = F.lit(1.0), F.lit(0.0)
    return (
        table(spark, folder, "supplier")
        .select(
            key.cast("int").alias("image"),
            F.lit(64).alias("width"),
            F.lit(48).alias("height"),
            (F.lit(60.0) + key).alias("fx"),
            (F.lit(60.0) + key).alias("fy"),
            F.lit(32.0).alias("cx"),
            F.lit(24.0).alias("cy"),
            F.when(even, one).otherwise(zero).alias("r00"),
            F.when(even, zero).otherwise(-one).alias("r01"),
            zero.alias("r02"),
            F.when(even, zero).otherwise(one).alias("r10"),
            F.when(even, one).otherwise(zero).alias("r11"),
            zero.alias("r12"),
            zero.alias("r20"),
            zero.alias("r21"),
            one.alias("r22"),
            (key * F.lit(1.0) - F.lit(5.0)).alias("t0"),
            F.lit(-3.0).alias("t1"),
            F.lit(5.0).alias("t2"),
        )
    )


def instances(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    x = F.floor((key % 100) / F.lit(5.0))
    strip = F.floor((key % 100) / F.lit(20.0)).cast("long")
    return (
        table(spark, folder, "orders")
        .select("o_orderkey", "o_custkey")
        .withColumns(_pixel_columns())
        .select(
            "image",
            "y",
            "x",
            (F.floor(x / F.lit(4.0)) + 5 * F.floor(key / F.lit(1000.0))).cast("int").alias("instance_id"),
            F.when((F.col("o_custkey") + strip) % 4 < 3, 1).otherwise(0).alias("mask"),
        )
    )


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, folder, "supplier").select(
        (key % 5).cast("int").alias("image"),
        (nation % 3).cast("int").alias("prompt_idx"),
        _choose((nation % 3 == 0, 101), (nation % 3 == 1, 103), otherwise=104).alias("class_id"),
        key.cast("int").alias("box_idx"),
        (((key * 7) % 15) * F.lit(1.0)).alias("x1"),
        (((key * 3) % 20) * F.lit(1.0)).alias("y1"),
        (((key * 7) % 15) + F.lit(4.5)).alias("x2"),
        (((key * 3) % 20) + F.lit(12.5)).alias("y2"),
        ((key % 9 + 1) / F.lit(10.0)).alias("score"),
    )


def entities(spark: SparkSession, folder: str) -> DataFrame:
    def named(letter: str, column: str):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    nation = F.col("n_nationkey")
    roots = table(spark, folder, "region").select(
        named("R", "r_regionkey").alias("entity_id"),
        F.lit("Building").alias("type"),
        F.lit(None).cast("string").alias("parent_id"),
    )
    middle = table(spark, folder, "nation").select(
        named("N", "n_nationkey").alias("entity_id"),
        _choose(
            (nation % 4 == 0, "WallSurface"),
            (nation % 4 == 1, "RoofSurface"),
            (nation % 4 == 2, "Window"),
            otherwise="Installation",
        ).alias("type"),
        named("R", "n_regionkey").alias("parent_id"),
    )
    leaves = table(spark, folder, "customer").select(
        named("C", "c_custkey").alias("entity_id"),
        F.lit("Part").alias("type"),
        named("N", "c_nationkey").alias("parent_id"),
    )
    return roots.unionByName(middle).unionByName(leaves)


def instance_entity(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("int").alias("instance_id"),
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity_id"),
    )
