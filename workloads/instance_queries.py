"""Instances: hierarchy labels, masks, boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions.paths import joined_prompts
from rasterloom.operators import features, hierarchy, instances
from workloads import views
from workloads.registry import query, r6, rounded, table

CLASS_TYPES = {1: ["WallSurface"], 2: ["Window"], 12: ["RoofSurface"], 50: ["Building", "Installation"]}

CLOSURE_SQL = """
tree AS (SELECT entity_id AS root, type AS root_type, entity_id FROM v_entities
  UNION SELECT t.root, t.root_type, e.entity_id FROM tree t JOIN v_entities e ON e.parent_id = t.entity_id)"""


@query(
    "hierarchy_closure",
    f"""WITH RECURSIVE {views.ENTITIES_SQL}, {CLOSURE_SQL}
    SELECT DISTINCT root_type AS type, entity_id FROM tree WHERE root_type IN ('Window', 'WallSurface')""",
)
def hierarchy_closure(spark, folder):
    return hierarchy.descendants(views.entities(spark, folder), ["Window", "WallSurface"])


HIERARCHY_SQL = f"""{views.ENTITIES_SQL}, {CLOSURE_SQL},
prio AS (SELECT * FROM (VALUES ('Window', 0, 2, 2), ('RoofSurface', 2, 3, 12), ('WallSurface', 3, 1, 1), ('Building', 5, 4, 50), ('Installation', 6, 4, 50))
  p(type, r, o, c)),
ent_label AS (SELECT t.entity_id, arg_min(p.c, p.r * 100 + p.o) AS label FROM tree t JOIN prio p ON p.type = t.root_type GROUP BY 1),
h_labels AS (SELECT CAST(c_custkey AS INT) AS instance_id, label FROM customer JOIN ent_label ON entity_id = concat('C', CAST(c_custkey AS STRING)))"""


@query("hierarchy_labels", f"WITH RECURSIVE {HIERARCHY_SQL} SELECT instance_id, label FROM h_labels")
def hierarchy_labels(spark, folder):
    return hierarchy.hierarchy_labels(
        views.entities(spark, folder), views.instance_entity(spark, folder), CLASS_TYPES
    )


@query(
    "ioa_select",
    f"""WITH {views.INSTANCES_SQL} SELECT image, instance_id, count(*) AS area, CAST(sum(mask) AS BIGINT) AS inside,
    round(sum(mask) / count(*), 6) AS share FROM v_instances GROUP BY 1, 2 HAVING sum(mask) / count(*) > 0.7""",
)
def ioa_select(spark, folder):
    return rounded(instances.select_by_share(views.instances(spark, folder), 0.7), "share")


SELECTED_SQL = """
anchor AS (SELECT * FROM v_instances WHERE image = (SELECT min(image) FROM v_instances)),
sel AS (SELECT 1 AS class_id, instance_id FROM anchor GROUP BY instance_id HAVING avg(mask) > 0.7
  UNION ALL SELECT 2, instance_id FROM anchor GROUP BY instance_id HAVING avg(1 - mask) > 0.2)"""


def _selected(spark, folder):
    """Ids chosen on the anchor frame by two masks, for two classes."""
    from rasterloom.operators.inventory import anchor_image

    all_pixels = views.instances(spark, folder)
    anchor = all_pixels.join(anchor_image(all_pixels), "image", "left_semi")
    first = instances.select_by_share(anchor, 0.7, by=()).select(F.lit(1).alias("class_id"), "instance_id")
    inverse = anchor.withColumn("mask", 1 - F.col("mask"))
    second = instances.select_by_share(inverse, 0.2, by=()).select(F.lit(2).alias("class_id"), "instance_id")
    return all_pixels, first.unionByName(second)


@query(
    "mask_transfer",
    f"""WITH {views.INSTANCES_SQL}, {SELECTED_SQL}
    SELECT s.class_id, v.image, v.y, v.x, v.instance_id FROM v_instances v JOIN sel s USING (instance_id)""",
)
def mask_transfer(spark, folder):
    pixels, selected = _selected(spark, folder)
    return instances.transfer_mask(pixels.drop("mask"), selected)


@query(
    "mask_flags",
    f"""WITH {views.INSTANCES_SQL}, {SELECTED_SQL},
    c AS (SELECT unnest([1, 2]) AS class_id)
    SELECT v.image, c.class_id, count(*) AS pixels, CAST(sum(CASE WHEN s.instance_id IS NULL THEN 0 ELSE 255 END) AS BIGINT) AS total
    FROM v_instances v CROSS JOIN c LEFT JOIN sel s ON s.class_id = c.class_id AND s.instance_id = v.instance_id GROUP BY 1, 2""",
)
def mask_flags(spark, folder):
    pixels, selected = _selected(spark, folder)
    flags = instances.mask_flags(pixels.drop("mask"), selected, [1, 2])
    return flags.groupBy("image", "class_id").agg(
        F.count("*").alias("pixels"), F.sum("value").alias("total")
    )


@query(
    "instance_raster_lookup",
    f"""WITH RECURSIVE {views.INSTANCES_SQL}, {HIERARCHY_SQL}
    SELECT image, y, x, label FROM v_instances JOIN h_labels USING (instance_id)""",
)
def instance_raster_lookup(spark, folder):
    return instances.rasterize(views.instances(spark, folder), hierarchy_labels(spark, folder))


# --- boxes ------------------------------------------------------------------------

BOXES_INT_SQL = """
bi AS (SELECT *, CAST(round_even(x1, 0) AS INT) AS ix1, CAST(round_even(x2, 0) AS INT) AS ix2,
  CAST(round_even(y1, 0) AS INT) AS iy1, CAST(round_even(y2, 0) AS INT) AS iy2 FROM v_boxes),
areas AS (SELECT image, instance_id, count(*) AS area FROM v_instances WHERE instance_id NOT IN (0, -1) GROUP BY 1, 2),
ov AS (SELECT b.image, b.prompt_idx, b.box_idx, b.class_id, b.score, i.instance_id, count(*) AS inside
  FROM bi b JOIN v_instances i ON i.image = b.image AND i.x >= ix1 AND i.x < ix2 AND i.y >= iy1 AND i.y < iy2
  WHERE i.instance_id NOT IN (0, -1) GROUP BY 1, 2, 3, 4, 5, 6),
box_ov AS (SELECT ov.*, area, inside / area AS overlap FROM ov JOIN areas USING (image, instance_id))"""


@query(
    "box_overlap",
    f"""WITH {views.INSTANCES_SQL}, {views.BOXES_SQL}, {BOXES_INT_SQL}
    SELECT image, prompt_idx, box_idx, instance_id, inside, area, round(overlap, 6) AS overlap FROM box_ov""",
)
def box_overlap(spark, folder):
    found = instances.box_overlap(views.instances(spark, folder), views.boxes(spark, folder))
    return rounded(found, "overlap")


@query(
    "box_vote",
    f"""WITH {views.INSTANCES_SQL}, {views.BOXES_SQL}, {BOXES_INT_SQL},
    r AS (SELECT *, score * overlap AS s, row_number() OVER (PARTITION BY image, instance_id ORDER BY score * overlap DESC, prompt_idx, box_idx) AS rn
          FROM box_ov WHERE overlap >= 0.3)
    SELECT image, instance_id, class_id AS label, round(s, 6) AS score FROM r WHERE rn = 1 AND s >= 0.2""",
)
def box_vote(spark, folder):
    boxes = views.boxes(spark, folder)
    overlaps = instances.box_overlap(views.instances(spark, folder), boxes)
    return rounded(instances.vote_labels(overlaps, boxes), "score")


RAW_BOXES_SQL = """
raw AS (SELECT CAST(s_suppkey % 7 AS INT) AS image, CAST(s_nationkey % 3 AS INT) AS prompt_idx, CAST(s_suppkey AS INT) AS box_idx,
  CASE WHEN s_suppkey % 7 < 3 THEN (s_suppkey % 10) / 1e1 ELSE (s_suppkey % 90) * 1e0 END AS b0,
  CASE WHEN s_suppkey % 7 < 3 THEN (s_suppkey % 8) / 1e1 ELSE (s_suppkey % 70) * 1e0 END AS b1,
  CASE WHEN s_suppkey % 7 < 3 THEN (s_suppkey % 10 + s_nationkey % 5 - 1) / 1e1 WHEN s_suppkey % 7 < 5 THEN (s_suppkey % 90) * 1e0 + s_nationkey ELSE s_nationkey * 1e0 END AS b2,
  CASE WHEN s_suppkey % 7 < 3 THEN (s_suppkey % 8 + 1) / 1e1 WHEN s_suppkey % 7 < 5 THEN (s_suppkey % 70) * 1e0 + 5 ELSE s_nationkey / 2e0 END AS b3
FROM supplier),
st AS (SELECT image, prompt_idx, max(greatest(b0, b1, b2, b3)) AS top, avg(CASE WHEN b2 < b0 OR b3 < b1 THEN 1e0 ELSE 0e0 END) AS inv FROM raw GROUP BY 1, 2),
fr AS (SELECT CAST(i AS INT) AS image, 80 AS det_width, 60 AS det_height, 120 + i AS width, 100 AS height FROM range(7) r(i)),
sc AS (SELECT raw.*, width, height, det_width, det_height, inv > 0.3 AS ctr,
  b0 * (CASE WHEN top <= 1.5 THEN det_width ELSE 1 END) AS a, b1 * (CASE WHEN top <= 1.5 THEN det_height ELSE 1 END) AS b,
  b2 * (CASE WHEN top <= 1.5 THEN det_width ELSE 1 END) AS c, b3 * (CASE WHEN top <= 1.5 THEN det_height ELSE 1 END) AS d
  FROM raw JOIN st USING (image, prompt_idx) JOIN fr USING (image)),
co AS (SELECT *, (CASE WHEN ctr THEN a - 0.5e0 * c ELSE a END) * (width / CAST(det_width AS DOUBLE)) AS p, (CASE WHEN ctr THEN a + 0.5e0 * c ELSE c END) * (width / CAST(det_width AS DOUBLE)) AS q,
  (CASE WHEN ctr THEN b - 0.5e0 * d ELSE b END) * (height / CAST(det_height AS DOUBLE)) AS r, (CASE WHEN ctr THEN b + 0.5e0 * d ELSE d END) * (height / CAST(det_height AS DOUBLE)) AS s FROM sc),
norm AS (SELECT image, prompt_idx, box_idx, least(greatest(least(p, q), 0), width - 1) AS x1, least(greatest(least(r, s), 0), height - 1) AS y1,
  least(greatest(greatest(p, q), 0), width - 1) AS x2, least(greatest(greatest(r, s), 0), height - 1) AS y2 FROM co)"""


def _raw_boxes(spark, folder):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    group = key % 7
    ten, one = F.lit(10.0), F.lit(1.0)
    raw = table(spark, folder, "supplier").select(
        group.cast("int").alias("image"),
        (nation % 3).cast("int").alias("prompt_idx"),
        key.cast("int").alias("box_idx"),
        F.when(group < 3, key % 10 / ten).otherwise(key % 90 * one).alias("b0"),
        F.when(group < 3, key % 8 / ten).otherwise(key % 70 * one).alias("b1"),
        F.when(group < 3, (key % 10 + nation % 5 - 1) / ten)
        .when(group < 5, key % 90 * one + nation)
        .otherwise(nation * one)
        .alias("b2"),
        F.when(group < 3, (key % 8 + 1) / ten)
        .when(group < 5, key % 70 * one + 5)
        .otherwise(nation / F.lit(2.0))
        .alias("b3"),
    )
    frames = raw.select("image").distinct().select(
        "image",
        F.lit(80).alias("det_width"),
        F.lit(60).alias("det_height"),
        (F.lit(120) + F.col("image")).alias("width"),
        F.lit(100).alias("height"),
    )
    return raw, frames


@query(
    "box_normalise",
    f"""WITH {RAW_BOXES_SQL} SELECT image, prompt_idx, box_idx, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM norm""",
)
def box_normalise(spark, folder):
    out = instances.normalize_boxes(*_raw_boxes(spark, folder))
    return rounded(out, "x1", "y1", "x2", "y2").drop("b0", "b1", "b2", "b3")


@query(
    "box_scale",
    f"""WITH {RAW_BOXES_SQL} SELECT image, prompt_idx, box_idx, round(x1 * (60 / CAST(120 + image AS DOUBLE)), 6) AS x1, round(y1 * 0.25e0, 6) AS y1,
    round(x2 * (60 / CAST(120 + image AS DOUBLE)), 6) AS x2, round(y2 * 0.25e0, 6) AS y2 FROM norm""",
)
def box_scale(spark, folder):
    raw, frames = _raw_boxes(spark, folder)
    target = frames.select("image", F.lit(60).alias("width"), F.lit(25).alias("height"))
    boxes = instances.normalize_boxes(raw, frames).drop("b0", "b1", "b2", "b3")
    return rounded(instances.scale_boxes(boxes, frames, target), "x1", "y1", "x2", "y2")


@query(
    "box_labels_raster",
    f"""WITH {views.INSTANCES_SQL}, {views.BOXES_SQL}, {BOXES_INT_SQL},
    r AS (SELECT *, score * overlap AS s, row_number() OVER (PARTITION BY image, instance_id ORDER BY score * overlap DESC, prompt_idx, box_idx) AS rn
          FROM box_ov WHERE overlap >= 0.3)
    SELECT v.image, v.y, v.x, r.class_id AS label FROM v_instances v JOIN r USING (image, instance_id) WHERE rn = 1 AND s >= 0.2""",
)
def box_labels_raster(spark, folder):
    pixels = views.instances(spark, folder)
    boxes = views.boxes(spark, folder)
    voted = instances.vote_labels(instances.box_overlap(pixels, boxes), boxes)
    return instances.rasterize(pixels, voted, on=("image", "instance_id"))


# --- prompts ----------------------------------------------------------------------


def _classes(spark, folder):
    """Class table made from parts: brands as classes, their texts as prompts."""
    part = table(spark, folder, "part")
    return part.select(
        F.col("p_partkey").alias("class_id"),
        F.array(F.concat(F.lit(" "), F.col("p_name")), F.lit("  "), F.col("p_type"), F.concat("p_brand", F.lit(" "))).alias("prompts"),
    )


PROMPTS_SQL = "classes AS (SELECT p_partkey AS class_id, [concat(' ', p_name), '  ', p_type, concat(p_brand, ' ')] AS prompts FROM part)"


@query(
    "expand_prompts",
    f"WITH {PROMPTS_SQL} SELECT class_id, CAST(unnest([0, 1, 2, 3]) AS INT) AS prompt_idx, unnest(prompts) AS prompt FROM classes",
)
def expand_prompts(spark, folder):
    return features.expand_prompts(_classes(spark, folder))


@query("first_prompts", f"WITH {PROMPTS_SQL} SELECT class_id, 0 AS prompt_idx, prompts[1] AS prompt FROM classes")
def first_prompts(spark, folder):
    return features.expand_prompts(_classes(spark, folder), first_only=True)


@query(
    "join_prompts",
    f"""WITH {PROMPTS_SQL} SELECT class_id, array_to_string(list_filter(list_transform(prompts, lambda p: trim(p)), lambda p: p <> ''), ' . ') AS text FROM classes""",
)
def join_prompts(spark, folder):
    return _classes(spark, folder).select("class_id", joined_prompts(F.col("prompts")).alias("text"))


@query(
    "path_stems",
    """SELECT page_id, regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1) AS stem FROM pages""",
)
def path_stems(spark, folder):
    from rasterloom.functions.paths import stem

    return table(spark, folder, "pages").select("page_id", stem(F.col("url")).alias("stem"))
