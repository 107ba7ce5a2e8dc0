"""Whole evaluations, windowed prediction and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import instances, raster, tiles
from rasterloom.plans import evaluate, fusion, ingest, masks, predictors
from rasterloom.session import work_folder
from rasterloom.streaming import clouds, voxels
from workloads import views
from workloads.embedding_queries import NEGATIVE_LABELS, PIXELS_SQL, UNIT_SQL, _class_table, _pixels, _vectors
from workloads.instance_queries import (
    BOXES_INT_SQL,
    CLASS_TYPES,
    HIERARCHY_SQL,
)
from workloads.point_queries import VOXEL_SQL
from workloads.registry import query, rounded, table

CONFIG = evaluate.EvaluationConfig(
    class_names={1: "wall", 2: "window", 3: "door", 12: "roof", 101: "tree", 103: "person", 104: "car"},
    positive_ids=views.POSITIVE_IDS,
    negative_ids=views.NEGATIVE_IDS,
)


def _evaluation(spark, folder):
    """Two methods: the given prediction, and one that shifts every column by one."""
    rasters = views.raster(spark, folder)
    pred = views.layer(rasters, "pred")
    moved = pred.withColumn("x", F.col("x") + 1).filter(F.col("x") < views.RASTER_WIDTH)

    def method(pixels):
        positive = F.when(F.col("label").isin(*views.POSITIVE_IDS), F.lit(1))
        return pixels.select(*raster.PIXEL, positive.alias("pred_binary"), F.col("label").alias("pred_class"))

    return evaluate.evaluate(
        views.layer(rasters, "primary"),
        views.layer(rasters, "secondary"),
        views.raster_dims(rasters),
        {"given": method(pred), "moved": method(moved)},
        CONFIG,
    )


METHODS_SQL = views.FUSED_SQL + """,
truth AS (SELECT image, y, x, gt FROM scored),
preds AS (SELECT 'given' AS method, image, y, x, pred FROM fused WHERE pred IS NOT NULL
          UNION ALL SELECT 'moved', image, y, x + 1, pred FROM fused WHERE pred IS NOT NULL AND x + 1 < 20),
al AS (SELECT m.method, t.image, t.y, t.x, t.gt, p.pred FROM truth t CROSS JOIN (SELECT unnest(['given', 'moved']) AS method) m
       LEFT JOIN preds p ON p.method = m.method AND p.image = t.image AND p.y = t.y AND p.x = t.x)"""

EVALUATE_SQL = METHODS_SQL + """,
masks AS (SELECT method, image, 'gt' AS layer, gt AS label, y, x FROM al UNION ALL
          SELECT method, image, 'pred', pred, y, x FROM al WHERE pred IS NOT NULL),
dims AS (SELECT image, greatest(round_even(0.02 * sqrt((max(y) + 1) * (max(y) + 1) + 400.0), 0), 1) AS d FROM v_raster GROUP BY image),
ex AS (SELECT m.*, d, count(*) OVER (PARTITION BY method, image, layer, label, y ORDER BY x RANGE BETWEEN d PRECEDING AND d FOLLOWING) AS c
       FROM masks m JOIN dims USING (image)),
ey AS (SELECT *, count(*) OVER (PARTITION BY method, image, layer, label, x ORDER BY y RANGE BETWEEN d PRECEDING AND d FOLLOWING) AS c2
       FROM ex WHERE c = 2 * d + 1),
edge AS (SELECT m.* FROM masks m LEFT JOIN (SELECT * FROM ey WHERE c2 = 2 * d + 1) e USING (method, image, layer, label, y, x) WHERE e.c IS NULL),
eu AS (SELECT method, image, label, count(*) FILTER (WHERE layer = 'gt') AS g, count(*) FILTER (WHERE layer = 'pred') AS p FROM edge GROUP BY 1, 2, 3),
ei AS (SELECT a.method, a.image, a.label, count(*) AS i FROM edge a JOIN edge b USING (method, image, label, y, x)
       WHERE a.layer = 'gt' AND b.layer = 'pred' GROUP BY 1, 2, 3),
cc AS (SELECT g.method, g.image, g.class_id, g.tp, coalesce(p.n, 0) - g.tp AS fp, g.n - g.tp AS fn, t.n - g.n - coalesce(p.n, 0) + g.tp AS tn
  FROM (SELECT method, image, gt AS class_id, count(*) AS n, count(*) FILTER (WHERE pred = gt) AS tp FROM al GROUP BY 1, 2, 3) g
  JOIN (SELECT method, image, count(*) AS n FROM al GROUP BY 1, 2) t USING (method, image)
  LEFT JOIN (SELECT method, image, pred AS class_id, count(*) AS n FROM al WHERE pred IS NOT NULL GROUP BY 1, 2, 3) p USING (method, image, class_id)),
cs AS (SELECT cc.*, tp / (tp + fp + fn + 1e-9) AS iou, tp / (tp + fp + 1e-9) AS "precision", tp / (tp + fn + 1e-9) AS recall,
  CASE WHEN coalesce(g, 0) + coalesce(p, 0) = 0 THEN 1e0 ELSE coalesce(i, 0) / (g + p - coalesce(i, 0)) END AS boundary_iou
  FROM cc LEFT JOIN eu ON eu.method = cc.method AND eu.image = cc.image AND eu.label = cc.class_id
  LEFT JOIN ei ON ei.method = cc.method AND ei.image = cc.image AND ei.label = cc.class_id)"""


@query(
    "evaluate_report_class",
    f"""WITH {EVALUATE_SQL}
    SELECT method, class_id, round(avg(iou), 6) AS iou, round(avg(boundary_iou), 6) AS boundary_iou, round(avg("precision"), 6) AS "precision",
      round(avg(recall), 6) AS recall, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
      CAST(sum(tn) AS BIGINT) AS tn,
      CASE class_id WHEN 1 THEN 'wall' WHEN 2 THEN 'window' WHEN 3 THEN 'door' WHEN 12 THEN 'roof' WHEN 101 THEN 'tree' WHEN 103 THEN 'person' ELSE 'car' END AS class_name
    FROM cs GROUP BY method, class_id""",
)
def evaluate_report_class(spark, folder):
    return rounded(_evaluation(spark, folder).report_class, "iou", "boundary_iou", "precision", "recall")


@query(
    "evaluate_report_overall",
    f"""WITH {EVALUATE_SQL}, s AS (SELECT method, image, avg(iou) AS i, avg(boundary_iou) AS b, sum(tp) / sum(tp + fn) AS a FROM cs GROUP BY 1, 2)
    SELECT method, count(*) AS n_images, round(avg(i), 6) AS mean_iou, round(avg(b), 6) AS mean_boundary_iou, round(avg(a), 6) AS pixel_acc FROM s GROUP BY 1""",
)
def evaluate_report_overall(spark, folder):
    report = _evaluation(spark, folder).report_overall
    return rounded(report, "mean_iou", "mean_boundary_iou", "pixel_acc")


@query(
    "evaluate_report_binary",
    f"""WITH {METHODS_SQL}, bb AS (SELECT method, image, gt IN (1, 2, 3, 12) AS t, coalesce(pred IN (1, 2, 3, 12), false) AS p FROM al),
    c AS (SELECT method, image, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE NOT p AND NOT t) AS tn,
      count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE NOT p AND t) AS fn FROM bb GROUP BY 1, 2)
    SELECT method, count(*) AS n_images, round(avg(tp / (tp + fp + fn + 1e-9)), 6) AS iou, round(avg(tp / (tp + fp + 1e-9)), 6) AS "precision",
      round(avg(tp / (tp + fn + 1e-9)), 6) AS recall, round(avg((tp + tn) / (tp + tn + fp + fn + 1e-9)), 6) AS accuracy,
      round(avg(2 * tp / (2 * tp + fp + fn + 1e-9)), 6) AS f1 FROM c GROUP BY 1""",
)
def evaluate_report_binary(spark, folder):
    report = _evaluation(spark, folder).report_binary
    return rounded(report, "iou", "precision", "recall", "accuracy", "f1")


VIEW_SQL = """CASE WHEN pred IN (1, 2, 3, 12) THEN 200 WHEN pred IN (101, 103, 104) THEN 201 END"""


@query(
    "compare_methods",
    f"""WITH {METHODS_SQL}, pv AS (SELECT method, image, y, x, pred, {VIEW_SQL} AS pred_view FROM preds)
    SELECT method, image, pred AS pred_class, pred_view, count(*) AS n FROM pv JOIN truth USING (image, y, x) GROUP BY 1, 2, 3, 4""",
)
def compare_methods(spark, folder):
    """Predictions of both methods on common images, limited to labelled pixels."""
    done = _evaluation(spark, folder)
    cache = done.prediction_cache.filter(F.col("pred_class").isNotNull())
    truth = done.pixels.filter(F.col("gt").isNotNull())
    rows = evaluate.compare_methods(cache, truth)
    return rows.groupBy("method", "image", "pred_class", "pred_view").agg(F.count("*").alias("n"))


# --- predictors -------------------------------------------------------------------


@query(
    "predict_hierarchy",
    f"""WITH RECURSIVE {views.INSTANCES_SQL}, {HIERARCHY_SQL}, {UNIT_SQL},
    known AS (SELECT instance_id, label FROM h_labels WHERE instance_id % 2 = 0),
    sims AS (SELECT CAST(u.vec_id AS INT) AS instance_id, c.label AS class_id, list_dot_product(u.v, c.v) AS s FROM unit u CROSS JOIN cls c
             WHERE c.label NOT IN (1, 2) AND u.vec_id <> 0 AND CAST(u.vec_id AS INT) NOT IN (SELECT instance_id FROM known)),
    guess AS (SELECT instance_id, CASE WHEN max(s) >= 0.1 THEN arg_min(class_id, ROW(-s, class_id)) END AS label FROM sims GROUP BY 1),
    final AS (SELECT instance_id, label FROM known UNION ALL SELECT instance_id, label FROM guess)
    SELECT image, y, x, CASE WHEN label IN (1, 2, 12) THEN 1 END AS pred_binary, CAST(label AS INT) AS pred_class
    FROM v_instances JOIN final USING (instance_id) WHERE label IS NOT NULL""",
)
def predict_hierarchy(spark, folder):
    """Even instances are known to the entity tree, the others get the most similar class."""
    known = views.instance_entity(spark, folder).filter(F.col("instance_id") % 2 == 0)
    rows = _vectors(spark, folder)
    predictor = predictors.HierarchyPredictor(
        instance_pixels=views.instances(spark, folder).drop("mask"),
        entities=views.entities(spark, folder),
        instance_entity=known,
        instance_features=rows.select(F.col("vec_id").cast("int").alias("instance_id"), "feature"),
        prompt_vectors=rows.select(F.col("label").alias("class_id"), "feature"),
        class_types=CLASS_TYPES,
        positive_ids=(1, 2, 12),
        threshold=0.1,
    )
    return predictor.predict()


@query(
    "predict_features",
    f"""WITH {PIXELS_SQL},
    wide AS (SELECT image, y, x, max(r) FILTER (WHERE q = 0) AS r0 FROM rel GROUP BY 1, 2, 3),
    b AS (SELECT image, y, x, (r0 - min(r0) OVER w) / (max(r0) OVER w - min(r0) OVER w + 1e-9) AS c FROM wide WINDOW w AS (PARTITION BY image)),
    rel1 AS (SELECT * FROM rel WHERE q > 0),
    top1 AS (SELECT image, y, x, arg_min(q, ROW(-r, q)) AS q, max(r) AS r FROM rel1 GROUP BY 1, 2, 3),
    p AS (SELECT t.image, t.y, t.x, t.q, (t.r - low) / (high - low + 1e-9) AS c FROM top1 t JOIN rng USING (image, q))
    SELECT b.image, b.y, b.x, CASE WHEN b.c >= 0.35 THEN 1 END AS pred_binary, CASE WHEN p.c >= 0.4 THEN CAST(p.q + 10 AS INT) END AS pred_class
    FROM b JOIN p USING (image, y, x)""",
)
def predict_features(spark, folder):
    """Label 0 is the binary prompt, labels 1 to 7 are the class prompts."""
    rows = instances.prompt_rows(_class_table(spark, folder))
    predictor = predictors.FeaturePredictor(
        feature_pixels=_pixels(spark, folder),
        binary_prompts=[v for c, v in rows if c == 0],
        class_prompts=[v for c, v in rows if 0 < c < 8],
        class_ids=[c + 10 for c, _ in rows if 0 < c < 8],
        negatives=[v for c, v in rows if c in NEGATIVE_LABELS],
        dense=True,
    )
    return predictor.predict()


@query(
    "predict_boxes",
    f"""WITH {views.INSTANCES_SQL}, hv AS (SELECT image, max(y) + 1 AS height FROM v_instances GROUP BY image),
    {views.BOXES_SQL.replace("v_boxes AS", "v_boxes0 AS")},
    v_boxes AS (SELECT b.image, prompt_idx, class_id, box_idx, least(x1, 19) AS x1, least(y1, height - 1) AS y1,
      least(x2, 19) AS x2, least(y2, height - 1) AS y2, score FROM v_boxes0 b JOIN hv USING (image)),
    {BOXES_INT_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY image, instance_id ORDER BY score * overlap DESC, prompt_idx, box_idx) AS rn
          FROM box_ov WHERE overlap >= 0.3),
    part AS (SELECT image, instance_id, class_id FROM r WHERE rn = 1 AND score * overlap >= 0.2),
    r2 AS (SELECT *, row_number() OVER (PARTITION BY image, instance_id ORDER BY score * overlap DESC, prompt_idx, box_idx) AS rn
          FROM box_ov WHERE overlap >= 0.3 AND box_idx % 2 = 0),
    whole AS (SELECT image, instance_id, 1 AS one FROM r2 WHERE rn = 1 AND score * overlap >= 0.2)
    SELECT v.image, v.y, v.x, CAST(w.one AS INT) AS pred_binary, p.class_id AS pred_class FROM v_instances v
    LEFT JOIN part p USING (image, instance_id) LEFT JOIN whole w USING (image, instance_id)
    WHERE p.class_id IS NOT NULL OR w.one IS NOT NULL""",
)
def predict_boxes(spark, folder):
    pixels = views.instances(spark, folder).drop("mask")
    sizes = pixels.groupBy("image").agg((F.max("y") + 1).alias("height")).withColumn(
        "width", F.lit(views.RASTER_WIDTH)
    )
    boxes = views.boxes(spark, folder)
    raw = boxes.select(
        "image", "prompt_idx", "class_id", "box_idx", "score",
        *[F.col(c).alias(f"b{i}") for i, c in enumerate(("x1", "y1", "x2", "y2"))],
    )
    frames = sizes.withColumns({"det_width": F.col("width"), "det_height": F.col("height")})
    even = raw.filter(F.col("box_idx") % 2 == 0).withColumn("class_id", F.lit(1))
    predictor = predictors.BoxPredictor(
        instance_pixels=pixels, binary_boxes=even, class_boxes=raw, frames=frames, dims=sizes, box_format="corner"
    )
    return predictor.predict()


@query(
    "anchor_masks",
    f"""WITH {views.INSTANCES_SQL}, anchor AS (SELECT * FROM v_instances WHERE image = (SELECT min(image) FROM v_instances)),
    s AS (SELECT 7 AS class_id, instance_id FROM anchor GROUP BY instance_id HAVING avg(mask) > 0.7)
    SELECT s.class_id, v.image, v.y, v.x FROM v_instances v JOIN s USING (instance_id)""",
)
def anchor_masks(spark, folder):
    pixels = views.instances(spark, folder)
    first = pixels.agg(F.min("image")).first()[0]
    mask = pixels.filter((F.col("image") == first) & (F.col("mask") == 1)).select(F.lit(7).alias("class_id"), "y", "x")
    return masks.transfer_masks(pixels.drop("mask"), mask)


@query(
    "fuse_layers",
    f"""WITH {views.RASTER_SQL},
    m AS (SELECT image, y, x, primary_label AS p,
            CASE pred_label WHEN 2 THEN 100 WHEN 12 THEN 103 ELSE 0 END AS s FROM v_raster WHERE primary_label >= 0 OR pred_label >= 0)
    SELECT image, coalesce(p IN (1, 2, 3, 12), false) AS is_kept, CASE WHEN p NOT IN (1, 2, 3, 12) AND s > 0 THEN s ELSE p END AS fused, count(*) AS n
    FROM m GROUP BY 1, 2, 3""",
)
def fuse_layers(spark, folder):
    rasters = views.raster(spark, folder)
    out = fusion.fuse_layers(views.layer(rasters, "primary"), views.layer(rasters, "pred"), views.raster_dims(rasters))
    return out.groupBy(
        "image", F.col("kept").isNotNull().alias("is_kept"), F.coalesce("fused", F.lit(-1)).alias("fused")
    ).agg(F.count("*").alias("n"))


@query(
    "ingest_points",
    f"""WITH {views.POINTS_SQL}, {VOXEL_SQL}
    SELECT src_file, point_idx, CAST(x + 690826e0 - 690955e0 AS FLOAT) AS x, CAST(y + 5335877e0 - 5336042e0 AS FLOAT) AS y,
      CAST(z + 500e0 - 604e0 AS FLOAT) AS z, class FROM voxel WHERE rn = 1""",
)
def ingest_points(spark, folder):
    config = ingest.IngestConfig(
        strategy="voxel",
        voxel_size=4.0,
        shift=(690826.0, 5335877.0, 500.0),
        frame_shift=(-690955.0, -5336042.0, -604.0),
    )
    return ingest.as_output(ingest.ingest(views.points(spark, folder), config))


@query(
    "ingest_survey",
    f"""WITH {views.POINTS_SQL} SELECT src_file, point_idx, round(x - 4351e0, 6) AS x, round(y - 45937e0, 6) AS y,
    round(z * 0.3048e0 - 316e0, 6) AS z, CASE class WHEN 2 THEN 12 WHEN 3 THEN 2 ELSE class END AS class FROM v_points""",
)
def ingest_survey(spark, folder):
    config = ingest.SurveyConfig(shift=(-4351.0, -45937.0, -316.0))
    return rounded(ingest.ingest_survey(views.points(spark, folder), config), "x", "y", "z")


# --- windowed prediction ----------------------------------------------------------

WINDOW, STRIDE = 8, 6

TILES_SQL = views.RASTER_SQL + f""",
dims AS (SELECT image, max(y) + 1 AS h, 20 AS w FROM v_raster GROUP BY image),
oy AS (SELECT DISTINCT image, h, w, y0 FROM (SELECT image, h, w, unnest(range(0, h, {STRIDE})) AS y0 FROM dims UNION ALL SELECT image, h, w, greatest(h - {WINDOW}, 0) FROM dims)),
ox AS (SELECT DISTINCT image, x0 FROM (SELECT image, unnest(range(0, w, {STRIDE})) AS x0 FROM dims UNION ALL SELECT image, greatest(w - {WINDOW}, 0) FROM dims)),
win AS (SELECT image, y0, x0, least(y0 + {WINDOW}, h) AS y1, least(x0 + {WINDOW}, w) AS x1 FROM oy JOIN ox USING (image)),
tile_px AS (SELECT v.*, win.y0, win.x0 FROM v_raster v JOIN win ON win.image = v.image AND v.y >= y0 AND v.y < y1 AND v.x >= x0 AND v.x < x1),
tile_sc AS (SELECT image, y, x, c AS class_id, CASE c WHEN 0 THEN ((primary_label * 7 + y0 * 3 + x0) % 11) / 8e0
    WHEN 1 THEN ((pred_label + y0 + x0 * 5) % 13) / 8e0 ELSE ((secondary_label + y0 + x0) % 7) / 4e0 END AS score
  FROM tile_px CROSS JOIN (SELECT unnest([0, 1, 2]) AS c)),
tile_mean AS (SELECT image, y, x, class_id, avg(score) AS score FROM tile_sc GROUP BY 1, 2, 3, 4)"""


@query(
    "window_grid",
    f"WITH {TILES_SQL} SELECT image, CAST(y0 AS INT) AS y0, CAST(x0 AS INT) AS x0, CAST(y1 AS INT) AS y1, CAST(x1 AS INT) AS x1 FROM win",
)
def window_grid(spark, folder):
    return tiles.window_grid(views.raster_dims(views.raster(spark, folder)), WINDOW, STRIDE)


@query(
    "tile_stitch",
    f"""WITH {TILES_SQL} SELECT image, y, x, CAST(arg_min(class_id, ROW(-score, class_id)) AS INT) AS label, round(max(score), 6) AS score
    FROM tile_mean GROUP BY 1, 2, 3""",
)
def tile_stitch(spark, folder):
    rasters = views.raster(spark, folder)
    cut = tiles.cut_windows(rasters, views.raster_dims(rasters), WINDOW, STRIDE)
    y0, x0 = F.col("y0"), F.col("x0")
    by_class = [
        (F.col("primary_label") * 7 + y0 * 3 + x0) % 11 / F.lit(8.0),
        (F.col("pred_label") + y0 + x0 * 5) % 13 / F.lit(8.0),
        (F.col("secondary_label") + y0 + x0) % 7 / F.lit(4.0),
    ]
    scores = cut.select(*raster.PIXEL, F.posexplode(F.array(*by_class)).alias("class_id", "score"))
    return rounded(tiles.stitch_windows(scores), "score")


@query(
    "predict_windows",
    f"""WITH {TILES_SQL},
    s AS (SELECT image, y, x, y0, x0, CAST(primary_label AS DOUBLE) AS s0, CAST(pred_label AS DOUBLE) AS s1, 60e0 AS s2,
      primary_label * 0.5e0 + max(pred_label) OVER (PARTITION BY image, y0, x0) * 0.25e0 AS s3 FROM tile_px),
    m AS (SELECT image, y, x, avg(s0) AS s0, avg(s1) AS s1, avg(s2) AS s2, avg(s3) AS s3 FROM s GROUP BY 1, 2, 3)
    SELECT image, y, x, CASE greatest(s0, s1, s2, s3) WHEN s0 THEN 0 WHEN s1 THEN 1 WHEN s2 THEN 2 ELSE 3 END AS label,
      round(greatest(s0, s1, s2, s3), 4) AS score FROM m""",
)
def predict_windows(spark, folder):
    """Scores come from a window's pixels and its own maximum, so that windows differ."""

    def model(block):
        first, second = block[..., 0].astype(np.float64), block[..., 1].astype(np.float64)
        return np.stack([first, second, np.full(first.shape, 60.0), first * 0.5 + second.max() * 0.25], axis=-1)

    rasters = views.raster(spark, folder)
    pixels = rasters.select(*raster.PIXEL, F.col("primary_label").alias("r"), F.col("pred_label").alias("g"))
    labels = tiles.predict_labels(pixels, views.raster_dims(rasters), model, ("r", "g"), WINDOW, STRIDE)
    return labels.withColumn("score", F.round("score", 4))


# --- streams ----------------------------------------------------------------------


def _event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet")
    return reader.parquet(folder)


def _in_two_runs(spark, folder, target, start):
    """All events as six files: three are streamed one by one, then the rest after a restart from the checkpoint."""
    events = table(spark, folder, "events")
    late = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 1
    for arriving in (~late, late):
        events.filter(arriving).repartition(3).write.mode("append").parquet(f"{target}/arrivals")
        reader = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
        start(reader.parquet(f"{target}/arrivals")).awaitTermination()


@query(
    "stream_running_counts",
    """SELECT event_type AS class, count(*) AS n_original, count(*) FILTER (WHERE event_id % 10 < 3) AS n_kept FROM events GROUP BY 1""",
)
def stream_running_counts(spark, folder):
    """Six files are six micro-batches; counts live in the state between them and over a restart."""
    target = work_folder(spark, "running-counts")

    def store(batch, number):
        batch.write.mode("overwrite").parquet(f"{target}/counts")

    def start(stream):
        stream = stream.withColumnRenamed("event_type", "class")
        counts = clouds.running_counts(stream, kept=F.col("event_id") % 10 < 3)
        return clouds.start_counts(counts, store, f"{target}/state")

    _in_two_runs(spark, folder, target, start)
    return spark.read.parquet(f"{target}/counts")


def _cloud_stream(spark, folder):
    return _as_cloud(_event_stream(spark, folder))


def _as_cloud(events):
    """Events as points: the id is the position, coordinates follow from it."""
    key = F.col("event_id")
    return events.select(
        F.lit("events").alias("src_file"),
        key.alias("point_idx"),
        (key % 97 / F.lit(10.0)).alias("x"),
        (key * 31 % 89 / F.lit(10.0)).alias("y"),
        (F.col("user_id") % 50 / F.lit(10.0)).alias("z"),
        (key % 4).cast("int").alias("class"),
    )


STREAM_POINTS_SQL = """e AS (SELECT event_id AS point_idx, (event_id % 97) / 1e1 AS x, (event_id * 31 % 89) / 1e1 AS y, (user_id % 50) / 1e1 AS z,
  CAST(event_id % 4 AS INT) AS class FROM events)"""


@query(
    "stream_ingest",
    f"WITH {STREAM_POINTS_SQL} SELECT point_idx, round(x + 10, 6) AS x, round(y - 4, 6) AS y, round(z + 0.5e0, 6) AS z, class FROM e",
)
def stream_ingest(spark, folder):
    target = work_folder(spark, "ingest")
    config = ingest.IngestConfig(shift=(10.0, -4.0, 0.0), frame_shift=(0.0, 0.0, 0.5))
    clouds.start_ingest(_cloud_stream(spark, folder), config, f"{target}/out", f"{target}/state").awaitTermination()
    return rounded(spark.read.parquet(f"{target}/out").drop("src_file"), "x", "y", "z")


@query(
    "stream_sampled_ingest",
    f"""WITH {STREAM_POINTS_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY floor(x), floor(y), floor(z) ORDER BY class, point_idx) AS rn FROM e)
    SELECT point_idx, class FROM v WHERE rn = 1""",
)
def stream_sampled_ingest(spark, folder):
    """The one event file is one micro-batch, sampled by voxel and stored."""
    target = work_folder(spark, "sampled-ingest")
    config = ingest.IngestConfig(strategy="voxel", voxel_size=1.0)
    clouds.start_sampled_ingest(
        _cloud_stream(spark, folder), config, f"{target}/out", f"{target}/state"
    ).awaitTermination()
    return spark.read.parquet(f"{target}/out").select("point_idx", "class")


@query(
    "stream_voxel_state",
    f"""WITH {STREAM_POINTS_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY floor(x), floor(y), floor(z) ORDER BY class, point_idx) AS rn FROM e)
    SELECT point_idx, x, y, z, class FROM v WHERE rn = 1""",
)
def stream_voxel_state(spark, folder):
    """Six micro-batches and a restart keep one point a voxel, as one batch over all events does."""
    target = work_folder(spark, "voxel-state")

    def start(stream):
        return voxels.start_voxel_ingest(_as_cloud(stream), 1.0, f"{target}/out", f"{target}/state")

    _in_two_runs(spark, folder, target, start)
    return voxels.current_voxels(spark, f"{target}/out").drop("src_file")
