"""Label rasters: remapping, fusing, comparing."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import colors, labels
from rasterloom.operators import raster
from workloads import views
from workloads.registry import query

# Shipped configuration values of the evaluated data set.
MERGE_MAP = {1: [1, 5, 6, 7, 8, 13], 200: [1, 2, 3, 12, 5, 6, 7, 8, 13]}
CHAIN_MAP = {3: [2], 2: [12], 5: [3], 9: [7]}
ID_MAP = {101: 201, 103: 203, 2: 100}
KEEP_IDS = (1, 2, 3, 12)
COLORS = {
    -1: (0, 0, 0),
    0: (105, 105, 105),
    1: (255, 242, 204),
    2: (141, 169, 219),
    3: (198, 89, 17),
    12: (192, 0, 0),
    101: (80, 126, 46),
    103: (171, 159, 158),
    104: (28, 97, 135),
}


@query(
    "fuse_priority",
    f"""WITH {views.FUSED_SQL}
    SELECT image, y, x, gt AS label FROM scored""",
)
def fuse_priority(spark, folder):
    rasters = views.raster(spark, folder)
    primary = raster.drop_unknown(views.layer(rasters, "primary"), views.CLASS_IDS)
    secondary = raster.drop_unknown(views.layer(rasters, "secondary"), views.CLASS_IDS)
    return raster.fuse_priority(primary, secondary)


@query(
    "drop_unknown",
    f"""WITH {views.RASTER_SQL}
    SELECT image, y, x, secondary_label AS label FROM v_raster
    WHERE secondary_label IN (1, 2, 3, 12, 101, 103, 104)""",
)
def drop_unknown(spark, folder):
    rasters = views.raster(spark, folder)
    classes = spark.createDataFrame([(c,) for c in views.CLASS_IDS], "class_id int")
    return raster.drop_unknown(views.layer(rasters, "secondary"), classes)


@query(
    "merge_sequential",
    f"""WITH {views.RASTER_SQL},
    s1 AS (SELECT image, y, x, CASE WHEN primary_label IN (5, 6, 7, 8, 13) THEN 1 ELSE primary_label END AS l
           FROM v_raster WHERE primary_label >= 0)
    SELECT image, y, x, CASE WHEN l IN (1, 2, 3, 12, 5, 6, 7, 8, 13) THEN 200 ELSE l END AS label FROM s1""",
)
def merge_sequential(spark, folder):
    return raster.merge_labels(views.layer(views.raster(spark, folder), "primary"), MERGE_MAP)


@query(
    "merge_chain",
    f"""WITH {views.RASTER_SQL},
    s1 AS (SELECT image, y, x, CASE WHEN primary_label = 2 THEN 3 ELSE primary_label END AS l
           FROM v_raster WHERE primary_label >= 0),
    s2 AS (SELECT image, y, x, CASE WHEN l = 12 THEN 2 ELSE l END AS l FROM s1),
    s3 AS (SELECT image, y, x, CASE WHEN l = 3 THEN 5 ELSE l END AS l FROM s2)
    SELECT image, y, x, CASE WHEN l = 7 THEN 9 ELSE l END AS label FROM s3""",
)
def merge_chain(spark, folder):
    return raster.merge_labels(views.layer(views.raster(spark, folder), "primary"), CHAIN_MAP)


@query(
    "remap_simultaneous",
    f"""WITH {views.POINTS_SQL}
    SELECT src_file, point_idx, CASE class WHEN 2 THEN 12 WHEN 3 THEN 2 ELSE class END AS class FROM v_points""",
)
def remap_simultaneous(spark, folder):
    from rasterloom.operators.points import remap_classes

    return remap_classes(views.points(spark, folder), {2: 12, 3: 2}).select("src_file", "point_idx", "class")


@query(
    "map_ids",
    f"""WITH {views.RASTER_SQL}
    SELECT image, y, x, CASE secondary_label WHEN 101 THEN 201 WHEN 103 THEN 203 WHEN 2 THEN 100 ELSE 0 END AS label
    FROM v_raster WHERE secondary_label >= 0""",
)
def map_ids(spark, folder):
    return raster.map_labels(views.layer(views.raster(spark, folder), "secondary"), ID_MAP)


@query(
    "split_layers",
    f"""WITH {views.RASTER_SQL},
    m AS (SELECT image, y, x, primary_label AS p,
            CASE secondary_label WHEN 101 THEN 201 WHEN 103 THEN 203 ELSE 0 END AS s
          FROM v_raster WHERE primary_label >= 0 OR secondary_label >= 0)
    SELECT image, y, x,
      CASE WHEN p IN (1, 2, 3, 12) THEN p ELSE 0 END AS kept,
      CASE WHEN p NOT IN (1, 2, 3, 12) AND s > 0 THEN s ELSE 0 END AS filled,
      CASE WHEN p NOT IN (1, 2, 3, 12) AND s > 0 THEN s ELSE p END AS fused
    FROM m""",
)
def split_layers(spark, folder):
    rasters = views.raster(spark, folder)
    mapped = raster.map_labels(views.layer(rasters, "secondary"), ID_MAP)
    split = raster.split_layers(views.layer(rasters, "primary"), mapped, KEEP_IDS)
    return split.withColumns(
        {
            "kept": labels.with_sentinel(F.col("kept"), 0),
            "filled": labels.with_sentinel(F.col("filled"), 0),
            "fused": labels.with_sentinel(F.col("fused"), -1),
        }
    )


@query(
    "split_layers_merged",
    f"""WITH {views.RASTER_SQL},
    m AS (SELECT CASE WHEN primary_label IN (1, 2, 3, 12, 5) THEN 200 ELSE primary_label END AS p,
            CASE secondary_label WHEN 101 THEN 201 WHEN 103 THEN 203 ELSE 0 END AS s
          FROM v_raster WHERE primary_label >= 0 OR secondary_label >= 0)
    SELECT p IN (1, 2, 3, 12) AS is_kept, CASE WHEN s > 0 THEN s ELSE p END AS fused, count(*) AS n
    FROM m GROUP BY 1, 2""",
)
def split_layers_merged(spark, folder):
    """With the shipped merge map no primary pixel keeps a listed class."""
    rasters = views.raster(spark, folder)
    merged = raster.merge_labels(views.layer(rasters, "primary"), MERGE_MAP)
    mapped = raster.map_labels(views.layer(rasters, "secondary"), ID_MAP)
    split = raster.split_layers(merged, mapped, KEEP_IDS)
    return split.groupBy(
        F.col("kept").isNotNull().alias("is_kept"), labels.with_sentinel(F.col("fused"), -1).alias("fused")
    ).agg(F.count("*").alias("n"))


@query(
    "to_binary",
    f"""WITH {views.FUSED_SQL}
    SELECT image, y, x, CASE WHEN gt IN (1, 2, 3, 12) THEN 1 ELSE 0 END AS label FROM scored""",
)
def to_binary(spark, folder):
    return raster.to_binary(fuse_priority(spark, folder), views.POSITIVE_IDS)


@query(
    "collapse_levels",
    f"""WITH {views.FUSED_SQL}
    SELECT image, y, x,
      CASE WHEN gt IN (1, 2, 3, 12) THEN 200 WHEN gt IN (101, 103, 104) THEN 201 END AS gt_level,
      CASE WHEN pred IN (1, 2, 3, 12) THEN 200
           WHEN pred IN (101, 103, 104) THEN 201 END AS pred_level,
      CASE WHEN pred = 104 OR pred IN (1, 2, 3, 12) THEN 200
           WHEN pred IN (101, 103, 104) THEN 201 END AS pred_forced
    FROM scored""",
)
def collapse_levels(spark, folder):
    rasters = views.raster(spark, folder)
    both = raster.align_layers({"gt": fuse_priority(spark, folder), "pred": views.layer(rasters, "pred")})
    pos, neg = views.POSITIVE_IDS, views.NEGATIVE_IDS
    return both.filter(F.col("gt").isNotNull()).select(
        "image",
        "y",
        "x",
        labels.collapse_levels(F.col("gt"), pos, neg).alias("gt_level"),
        labels.collapse_levels(F.col("pred"), pos, neg).alias("pred_level"),
        labels.collapse_levels(F.col("pred"), pos, neg, force_positive=F.col("pred") == 104).alias("pred_forced"),
    )


@query(
    "error_flags",
    f"""WITH {views.FUSED_SQL}
    SELECT image, y, x, pred, gt AS truth, (pred IS NOT NULL AND pred = gt) AS correct FROM scored""",
)
def error_flags(spark, folder):
    rasters = views.raster(spark, folder)
    return raster.error_pixels(views.layer(rasters, "pred"), fuse_priority(spark, folder))


@query(
    "error_flags_binary",
    f"""WITH {views.FUSED_SQL}
    SELECT image, (gt IN (1, 2, 3, 12)) = coalesce(pred IN (1, 2, 3, 12), false) AS correct, count(*) AS n
    FROM scored GROUP BY 1, 2""",
)
def error_flags_binary(spark, folder):
    rasters = views.raster(spark, folder)
    both = raster.align_layers({"gt": fuse_priority(spark, folder), "pred": views.layer(rasters, "pred")})
    truth = labels.to_binary(F.col("gt"), views.POSITIVE_IDS) == 1
    pred = F.coalesce(labels.to_binary(F.col("pred"), views.POSITIVE_IDS) == 1, F.lit(False))
    return (
        both.filter(F.col("gt").isNotNull())
        .groupBy("image", labels.error_flag(pred, truth).alias("correct"))
        .agg(F.count("*").alias("n"))
    )


def _color_case(column: str, sep: str = "-") -> str:
    """Colour text of an id in SQL: reserved, configured, then the fallback list."""
    parts = [f"WHEN {column} IS NULL THEN '255-255-255'"]
    for known in (colors.RESERVED_COLORS, COLORS):
        parts += [f"WHEN {column} = {c} THEN '{sep.join(map(str, rgb))}'" for c, rgb in known.items()]
    size = len(colors.FALLBACK_COLORS)
    parts += [
        f"WHEN {column} % {size} = {i} THEN '{sep.join(map(str, rgb))}'"
        for i, rgb in enumerate(colors.FALLBACK_COLORS)
    ]
    return "CASE " + " ".join(parts) + " END"


@query(
    "palette",
    f"""WITH {views.RASTER_SQL},
    l AS (SELECT primary_label AS label FROM v_raster WHERE primary_label >= 0
          UNION ALL SELECT secondary_label + 99 FROM v_raster WHERE secondary_label >= 0)
    SELECT label, {_color_case('label')} AS color, count(*) AS n FROM l GROUP BY label""",
)
def palette(spark, folder):
    rasters = views.raster(spark, folder)
    primary = views.layer(rasters, "primary").select("label")
    shifted = views.layer(rasters, "secondary").select((F.col("label") + 99).alias("label"))
    counted = primary.unionByName(shifted).groupBy("label").agg(F.count("*").alias("n"))
    color = F.array_join(colors.palette_color(F.col("label"), COLORS).cast("array<string>"), "-")
    return counted.select("label", color.alias("color"), "n")


@query(
    "error_colors",
    f"""WITH {views.FUSED_SQL}
    SELECT image, CASE WHEN gt IS NULL THEN '255-255-255' WHEN pred IS NOT NULL AND pred = gt THEN '0-255-0'
                       ELSE '255-0-0' END AS color, count(*) AS n
    FROM fused WHERE gt IS NOT NULL OR pred IS NOT NULL GROUP BY 1, 2""",
)
def error_colors(spark, folder):
    rasters = views.raster(spark, folder)
    both = raster.align_layers({"gt": fuse_priority(spark, folder), "pred": views.layer(rasters, "pred")})
    flag = labels.error_flag(F.col("pred"), F.col("gt"))
    color = F.array_join(colors.error_color(flag).cast("array<string>"), "-")
    return both.groupBy("image", color.alias("color")).agg(F.count("*").alias("n"))


@query(
    "resample_nearest",
    f"""WITH {views.RASTER_SQL},
    dims AS (SELECT image, max(y) + 1 AS h0, 20 AS w0, CAST(floor((max(y) + 1) * 3 / 2e0) AS BIGINT) AS h, 13 AS w
             FROM v_raster GROUP BY image),
    rows_ AS (SELECT image, h0, w0, h, w, unnest(range(0, h)) AS y FROM dims),
    grid AS (SELECT *, unnest(range(0, w)) AS x FROM rows_)
    SELECT g.image, CAST(g.y AS INT) AS y, CAST(g.x AS INT) AS x, v.pred_label AS label
    FROM grid g JOIN v_raster v ON v.image = g.image AND v.y = (g.y * g.h0) // g.h AND v.x = (g.x * g.w0) // g.w
    WHERE v.pred_label >= 0""",
)
def resample_nearest(spark, folder):
    """Rows are stretched by 3/2 and columns squeezed from 20 to 13."""
    rasters = views.raster(spark, folder)
    dims = views.raster_dims(rasters)
    target = dims.select(
        "image", F.floor(F.col("height") * 3 / F.lit(2.0)).alias("height"), F.lit(13).alias("width")
    )
    return raster.resample_nearest(views.layer(rasters, "pred"), dims, target)


@query(
    "distinct_labels",
    f"""WITH {views.RASTER_SQL} SELECT DISTINCT image, pred_label AS label FROM v_raster WHERE pred_label >= 0""",
)
def distinct_labels(spark, folder):
    return raster.distinct_labels(views.layer(views.raster(spark, folder), "pred"))


@query(
    "shape_mismatches",
    f"""WITH {views.RASTER_SQL},
    ha AS (SELECT image, max(y) + 1 AS height FROM v_raster GROUP BY image),
    hb AS (SELECT image, max(y) + 1 AS height FROM v_raster WHERE secondary_label >= 0 AND image <> 3 OR y < 50 GROUP BY image)
    SELECT ha.image, ha.height, hb.height AS height_b FROM ha JOIN hb USING (image) WHERE ha.height <> hb.height""",
)
def shape_mismatches(spark, folder):
    rasters = views.raster(spark, folder)
    other = rasters.filter((F.col("secondary_label") >= 0) & (F.col("image") != 3) | (F.col("y") < 50))
    found = raster.shape_mismatches(views.raster_dims(rasters), views.raster_dims(other))
    return found.select("image", "height", "height_b")


@query(
    "union_masks",
    f"""WITH {views.RASTER_SQL}
    SELECT image, y, x FROM v_raster WHERE pred_label = 1
    UNION SELECT image, y, x FROM v_raster WHERE primary_label = 2
    UNION SELECT image, y, x FROM v_raster WHERE secondary_label = 103""",
)
def union_masks(spark, folder):
    rasters = views.raster(spark, folder)
    masks = [
        views.layer(rasters, name).filter(F.col("label") == label)
        for name, label in (("pred", 1), ("primary", 2), ("secondary", 103))
    ]
    return raster.union_masks(masks[0].unionByName(masks[1]).unionByName(masks[2]))


@query(
    "mask_by_truth",
    f"""WITH {views.FUSED_SQL}
    SELECT image, y, x, pred AS label FROM scored WHERE pred IS NOT NULL""",
)
def mask_by_truth(spark, folder):
    rasters = views.raster(spark, folder)
    return raster.mask_by_truth(views.layer(rasters, "pred"), fuse_priority(spark, folder))
