"""Scoring predictions and rolling scores up."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import labels
from rasterloom.operators import inventory, metrics, neighborhood, raster
from workloads import views
from workloads.raster_queries import fuse_priority
from workloads.registry import query, r6, rounded, table

CLASS_COUNTS_SQL = views.FUSED_SQL + """,
totals AS (SELECT image, count(*) AS total FROM scored GROUP BY image),
per_gt AS (SELECT image, gt AS class_id, count(*) AS actual,
             count(*) FILTER (WHERE pred = gt) AS tp FROM scored GROUP BY image, gt),
per_pred AS (SELECT image, pred AS class_id, count(*) AS predicted FROM scored WHERE pred IS NOT NULL GROUP BY image, pred),
class_counts AS (
  SELECT g.image, g.class_id, g.tp, coalesce(p.predicted, 0) - g.tp AS fp, g.actual - g.tp AS fn,
         t.total - g.actual - coalesce(p.predicted, 0) + g.tp AS tn
  FROM per_gt g JOIN totals t USING (image) LEFT JOIN per_pred p USING (image, class_id)),
class_scores AS (
  SELECT *, tp / (tp + fp + fn + 1e-9) AS iou, tp / (tp + fp + 1e-9) AS "precision", tp / (tp + fn + 1e-9) AS recall
  FROM class_counts)"""

BINARY_SQL = views.FUSED_SQL + """,
bin AS (SELECT image, gt IN (1, 2, 3, 12) AS t, coalesce(pred IN (1, 2, 3, 12), false) AS p FROM scored),
bin_counts AS (SELECT image, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE NOT p AND NOT t) AS tn,
  count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE NOT p AND t) AS fn FROM bin GROUP BY image),
bin_scores AS (SELECT *, tp / (tp + fp + fn + 1e-9) AS iou, tp / (tp + fp + 1e-9) AS "precision",
  tp / (tp + fn + 1e-9) AS recall, (tp + tn) / (tp + tn + fp + fn + 1e-9) AS accuracy,
  2 * tp / (2 * tp + fp + fn + 1e-9) AS f1, tp + tn + fp + fn AS pixel_count FROM bin_counts)"""


def _aligned(spark, folder, lines=False):
    rasters = views.raster(spark, folder)
    both = raster.align_layers(
        {
            "primary": raster.drop_unknown(views.layer(rasters, "primary"), views.CLASS_IDS),
            "secondary": raster.drop_unknown(views.layer(rasters, "secondary"), views.CLASS_IDS),
            "pred": views.layer(rasters, "pred"),
        },
        lines=lines,
    )
    return both.select(*raster.PIXEL, F.coalesce("primary", "secondary").alias("gt"), "pred").filter(
        F.col("gt").isNotNull()
    )


def _class_scores(spark, folder):
    return metrics.class_metrics(metrics.class_counts(metrics.confusion(_aligned(spark, folder))))


def _binary_scores(spark, folder):
    aligned = _aligned(spark, folder).withColumns(
        {
            "gt": labels.to_binary(F.col("gt"), views.POSITIVE_IDS),
            "pred": labels.to_binary(F.col("pred"), views.POSITIVE_IDS),
        }
    )
    return metrics.binary_metrics(metrics.binary_counts(aligned))


@query(
    "per_class_iou",
    f"""WITH {CLASS_COUNTS_SQL}
    SELECT class_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
           CAST(sum(tn) AS BIGINT) AS tn, round(sum(tp) / (sum(tp) + sum(fp) + sum(fn) + 1e-9), 6) AS iou
    FROM (SELECT g.class_id, g.tp, coalesce(p.predicted, 0) - g.tp AS fp, g.actual - g.tp AS fn,
                 t.total - g.actual - coalesce(p.predicted, 0) + g.tp AS tn
          FROM (SELECT class_id, sum(actual) AS actual, sum(tp) AS tp FROM per_gt GROUP BY class_id) g
          CROSS JOIN (SELECT sum(total) AS total FROM totals) t
          LEFT JOIN (SELECT class_id, sum(predicted) AS predicted FROM per_pred GROUP BY class_id) p USING (class_id))
    GROUP BY class_id""",
)
def per_class_iou(spark, folder):
    """Micro scores over all images: drop unknown ids, fuse, compare, count per class."""
    counts = metrics.class_counts(metrics.confusion(_aligned(spark, folder), by=()), by=())
    return metrics.class_metrics(counts).select("class_id", "tp", "fp", "fn", "tn", r6("iou").alias("iou"))


@query(
    "confusion",
    f"""WITH {views.FUSED_SQL} SELECT image, gt, pred, count(*) AS n FROM scored GROUP BY 1, 2, 3""",
)
def confusion(spark, folder):
    return metrics.confusion(_aligned(spark, folder))


@query("class_counts", f"WITH {CLASS_COUNTS_SQL} SELECT * FROM class_counts")
def class_counts(spark, folder):
    return metrics.class_counts(metrics.confusion(_aligned(spark, folder)))


@query(
    "class_metrics",
    f"""WITH {CLASS_COUNTS_SQL} SELECT image, class_id, tp, fp, fn, tn, round(iou, 6) AS iou,
    round("precision", 6) AS "precision", round(recall, 6) AS recall FROM class_scores""",
)
def class_metrics(spark, folder):
    return rounded(_class_scores(spark, folder), "iou", "precision", "recall")


@query(
    "binary_metrics",
    f"""WITH {BINARY_SQL} SELECT image, tp, tn, fp, fn, round(iou, 6) AS iou, round("precision", 6) AS "precision",
    round(recall, 6) AS recall, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, pixel_count FROM bin_scores""",
)
def binary_metrics(spark, folder):
    return rounded(_binary_scores(spark, folder), "iou", "precision", "recall", "accuracy", "f1")


@query(
    "binary_metrics_flags",
    """WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp,
      count(*) FILTER (WHERE toxic <> 1 AND quality <> 1) AS tn, count(*) FILTER (WHERE toxic = 1 AND quality <> 1) AS fp,
      count(*) FILTER (WHERE toxic <> 1 AND quality = 1) AS fn FROM labels)
    SELECT tp, tn, fp, fn, round(tp / (tp + fp + fn + 1e-9), 6) AS iou, round((tp + tn) / (tp + tn + fp + fn + 1e-9), 6) AS accuracy
    FROM c""",
)
def binary_metrics_flags(spark, folder):
    counts = metrics.binary_counts(table(spark, folder, "labels"), by=(), pred="toxic", truth="quality")
    return metrics.binary_metrics(counts).select(
        "tp", "tn", "fp", "fn", r6("iou").alias("iou"), r6("accuracy").alias("accuracy")
    )


@query(
    "image_summary",
    f"""WITH {CLASS_COUNTS_SQL} SELECT image, round(avg(iou), 6) AS mean_iou, CAST(sum(tp) AS BIGINT) AS correct_count,
    CAST(sum(tp + fn) AS BIGINT) AS pixel_count, round(sum(tp) / sum(tp + fn), 6) AS pixel_acc
    FROM class_scores GROUP BY image""",
)
def image_summary(spark, folder):
    return rounded(metrics.image_summary(_class_scores(spark, folder)), "mean_iou", "pixel_acc")


@query(
    "report_binary",
    f"""WITH {BINARY_SQL} SELECT 'model' AS method, count(*) AS n_images, round(avg(iou), 6) AS iou,
    round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(accuracy), 6) AS accuracy,
    round(avg(f1), 6) AS f1 FROM bin_scores""",
)
def report_binary(spark, folder):
    scores = _binary_scores(spark, folder).withColumn("method", F.lit("model"))
    return rounded(metrics.report_binary(scores), "iou", "precision", "recall", "accuracy", "f1")


@query(
    "report_macro",
    f"""WITH {CLASS_COUNTS_SQL} SELECT 'model' AS method, class_id, round(avg(iou), 6) AS iou,
    round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, CAST(sum(tp) AS BIGINT) AS tp,
    CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn
    FROM class_scores GROUP BY class_id""",
)
def report_macro(spark, folder):
    scores = _class_scores(spark, folder).withColumn("method", F.lit("model"))
    return rounded(metrics.report_class(scores), "iou", "precision", "recall")


@query(
    "report_overall",
    f"""WITH {CLASS_COUNTS_SQL},
    s AS (SELECT image, avg(iou) AS mean_iou, sum(tp) / sum(tp + fn) AS pixel_acc FROM class_scores GROUP BY image)
    SELECT 'model' AS method, count(*) AS n_images, round(avg(mean_iou), 6) AS mean_iou,
    round(avg(pixel_acc), 6) AS pixel_acc FROM s""",
)
def report_overall(spark, folder):
    summary = metrics.image_summary(_class_scores(spark, folder)).withColumn("method", F.lit("model"))
    return rounded(metrics.report_overall(summary), "mean_iou", "pixel_acc")


@query(
    "stability_pivot",
    f"""WITH {CLASS_COUNTS_SQL},
    o AS (SELECT avg(m) AS overall FROM (SELECT image, avg(iou) AS m FROM class_scores GROUP BY image))
    SELECT 'model' AS method, round(max(overall), 6) AS overall_mean_iou,
      round(avg(iou) FILTER (WHERE class_id = 101), 6) AS iou_101, round(avg(iou) FILTER (WHERE class_id = 103), 6) AS iou_103,
      CAST(sum(tp) FILTER (WHERE class_id = 101) AS BIGINT) AS tp_101, CAST(sum(tp) FILTER (WHERE class_id = 103) AS BIGINT) AS tp_103
    FROM class_scores, o""",
)
def stability_pivot(spark, folder):
    scores = _class_scores(spark, folder).withColumn("method", F.lit("model"))
    overall = metrics.report_overall(
        metrics.image_summary(scores, by=("method", "image")), by=("method",)
    )
    chosen = metrics.stability_subset(metrics.report_class(scores), overall, [101, 103])
    wide = chosen.groupBy("method", "overall_mean_iou").pivot("class_id", [101, 103]).agg(
        F.first("iou").alias("iou"), F.first("tp").alias("tp")
    )
    return wide.select(
        "method",
        r6("overall_mean_iou").alias("overall_mean_iou"),
        *[r6(f"{c}_iou").alias(f"iou_{c}") for c in (101, 103)],
        *[F.col(f"{c}_tp").alias(f"tp_{c}") for c in (101, 103)],
    )


@query(
    "summary_upsert",
    f"""WITH {CLASS_COUNTS_SQL},
    old AS (SELECT concat('m', CAST(image AS STRING)) AS method, count(*) AS n_classes FROM class_scores WHERE image < 4 GROUP BY image),
    new AS (SELECT concat('m', CAST(image AS STRING)) AS method, count(*) * 100 AS n_classes FROM class_scores WHERE image > 2 GROUP BY image)
    SELECT * FROM old WHERE method NOT IN (SELECT method FROM new) UNION ALL SELECT * FROM new""",
)
def summary_upsert(spark, folder):
    scores = _class_scores(spark, folder).withColumn("method", F.concat(F.lit("m"), F.col("image").cast("string")))
    old = scores.filter("image < 4").groupBy("method").agg(F.count("*").alias("n_classes"))
    new = scores.filter("image > 2").groupBy("method").agg((F.count("*") * 100).alias("n_classes"))
    return metrics.upsert(old, new)


# --- boundaries -------------------------------------------------------------------

ERODE_SQL = """
erode_x AS (SELECT *, count(*) OVER (PARTITION BY image, layer, label, y ORDER BY x RANGE BETWEEN {d} PRECEDING AND {d} FOLLOWING) AS cx
            FROM masks),
erode_y AS (SELECT *, count(*) OVER (PARTITION BY image, layer, label, x ORDER BY y RANGE BETWEEN {d} PRECEDING AND {d} FOLLOWING) AS cy
            FROM erode_x WHERE cx = 2 * {d} + 1),
edge AS (SELECT m.* FROM masks m LEFT JOIN (SELECT * FROM erode_y WHERE cy = 2 * {d} + 1) e
         USING (image, layer, label, y, x) WHERE e.cx IS NULL)"""

MASKS_SQL = """
masks AS (SELECT image, 'gt' AS layer, gt AS label, y, x FROM scored
          UNION ALL SELECT image, 'pred', pred, y, x FROM scored WHERE pred IS NOT NULL)"""


@query(
    "boundary",
    f"""WITH {views.FUSED_SQL}, {MASKS_SQL}, {ERODE_SQL.format(d=1)}
    SELECT m.image, m.label, count(*) AS pixels, count(e.x) AS boundary_pixels
    FROM masks m LEFT JOIN edge e USING (image, layer, label, y, x) WHERE m.layer = 'gt' GROUP BY 1, 2""",
)
def boundary(spark, folder):
    marked = neighborhood.mark_boundary(fuse_priority(spark, folder).withColumn("_d", F.lit(1)))
    return marked.groupBy("image", "label").agg(
        F.count("*").alias("pixels"), F.count_if("boundary").alias("boundary_pixels")
    )


BOUNDARY_SCORE_SQL = """
union_counts AS (SELECT image, label, count(*) FILTER (WHERE layer = 'gt') AS g, count(*) FILTER (WHERE layer = 'pred') AS p
                 FROM edge GROUP BY 1, 2),
inter_counts AS (SELECT a.image, a.label, count(*) AS i FROM edge a JOIN edge b USING (image, label, y, x)
                 WHERE a.layer = 'gt' AND b.layer = 'pred' GROUP BY 1, 2)"""


@query(
    "boundary_iou",
    f"""WITH {CLASS_COUNTS_SQL}, {MASKS_SQL},
    dims AS (SELECT image, greatest(round_even(0.02 * sqrt((max(y) + 1) * (max(y) + 1) + 400.0), 0), 1) AS d FROM v_raster GROUP BY image),
    runs_x AS (SELECT m.*, d, count(*) OVER w AS c FROM masks m JOIN dims USING (image)
      WINDOW w AS (PARTITION BY image, layer, label, y ORDER BY x RANGE BETWEEN d PRECEDING AND d FOLLOWING)),
    runs_y AS (SELECT *, count(*) OVER w AS c2 FROM runs_x WHERE c = 2 * d + 1
      WINDOW w AS (PARTITION BY image, layer, label, x ORDER BY y RANGE BETWEEN d PRECEDING AND d FOLLOWING)),
    edge AS (SELECT m.* FROM masks m LEFT JOIN (SELECT * FROM runs_y WHERE c2 = 2 * d + 1) e
         USING (image, layer, label, y, x) WHERE e.c IS NULL),
    {BOUNDARY_SCORE_SQL}
    SELECT c.image, c.class_id, coalesce(i.i, 0) AS boundary_inter,
      coalesce(u.g, 0) + coalesce(u.p, 0) - coalesce(i.i, 0) AS boundary_union,
      round(CASE WHEN coalesce(u.g, 0) + coalesce(u.p, 0) = 0 THEN 1.0
                 ELSE coalesce(i.i, 0) / (u.g + u.p - coalesce(i.i, 0)) END, 6) AS boundary_iou
    FROM class_counts c LEFT JOIN union_counts u ON u.image = c.image AND u.label = c.class_id
    LEFT JOIN inter_counts i ON i.image = c.image AND i.label = c.class_id""",
)
def boundary_iou(spark, folder):
    dims = views.raster_dims(views.raster(spark, folder))
    sized = neighborhood.with_boundary_width(_aligned(spark, folder, lines=True), dims)
    counts = metrics.class_counts(neighborhood.pixel_outcomes(sized).drop("pred_no"))
    return rounded(metrics.class_metrics(counts), "boundary_iou").select(
        "image", "class_id", "boundary_inter", "boundary_union", "boundary_iou"
    )


# --- image lists ------------------------------------------------------------------


def _image_lists(spark, folder):
    """Names made of the raster cells, so that layers lack some of each other's."""
    named = views.raster(spark, folder).withColumn(
        "image", F.concat(F.lit("img"), (F.col("image") * 1000 + F.col("y")).cast("string"))
    )
    primary = named.filter((F.col("primary_label") > 0) & (F.col("y") % 7 != 0))
    secondary = named.filter((F.col("secondary_label") > 0) & (F.col("y") % 5 != 0))
    pred = named.filter((F.col("pred_label") > 0) & (F.col("y") % 3 != 0))
    return primary.select("image"), secondary.select("image"), pred.select("image")


LISTS_SQL = views.RASTER_SQL + """,
named AS (SELECT *, concat('img', CAST(image * 1000 + y AS STRING)) AS name FROM v_raster),
la AS (SELECT DISTINCT name FROM named WHERE primary_label > 0 AND y % 7 <> 0),
lb AS (SELECT DISTINCT name FROM named WHERE secondary_label > 0 AND y % 5 <> 0),
lc AS (SELECT DISTINCT name FROM named WHERE pred_label > 0 AND y % 3 <> 0)"""


@query(
    "incomplete_pairs",
    f"""WITH {LISTS_SQL} SELECT name AS image, 'secondary' AS missing_in FROM la WHERE name NOT IN (SELECT name FROM lb)
    UNION ALL SELECT name, 'primary' FROM lb WHERE name NOT IN (SELECT name FROM la)""",
)
def incomplete_pairs(spark, folder):
    primary, secondary, _ = _image_lists(spark, folder)
    return inventory.incomplete_pairs(primary, secondary)


@query(
    "common_images",
    f"""WITH {LISTS_SQL} SELECT name AS image FROM la INTERSECT SELECT name FROM lb INTERSECT SELECT name FROM lc""",
)
def common_images(spark, folder):
    return inventory.common_images(*_image_lists(spark, folder))


@query(
    "image_union",
    f"""WITH {LISTS_SQL} SELECT name AS image FROM la UNION SELECT name FROM lb""",
)
def image_union(spark, folder):
    primary, secondary, _ = _image_lists(spark, folder)
    return primary.union(secondary).distinct()


@query(
    "image_difference",
    f"""WITH {LISTS_SQL} SELECT name AS image FROM la EXCEPT SELECT name FROM lc""",
)
def image_difference(spark, folder):
    primary, _, pred = _image_lists(spark, folder)
    return primary.subtract(pred)


@query(
    "first_n",
    f"""WITH {LISTS_SQL} SELECT v.name AS image, count(*) AS pixels FROM named v
    WHERE v.name IN (SELECT name FROM la ORDER BY name LIMIT 12) GROUP BY 1""",
)
def first_n(spark, folder):
    """The first twelve images of a run, and the pixels that remain for it."""
    primary, _, _ = _image_lists(spark, folder)
    named = views.raster(spark, folder).select(
        F.concat(F.lit("img"), (F.col("image") * 1000 + F.col("y")).cast("string")).alias("image")
    )
    return (
        named.join(inventory.first_images(primary, 12), "image", "left_semi")
        .groupBy("image")
        .agg(F.count("*").alias("pixels"))
    )


@query("anchor_image", f"WITH {LISTS_SQL} SELECT min(name) AS image FROM la")
def anchor_image(spark, folder):
    return inventory.anchor_image(_image_lists(spark, folder)[0])


@query(
    "missing_inputs",
    f"""WITH {LISTS_SQL},
    need AS (SELECT name, 'raster' AS label, concat('/a/', name, '.png') AS path FROM la
             UNION ALL SELECT name, 'raster', concat('/b/', name, '.png') FROM la
             UNION ALL SELECT name, 'truth', concat('/t/', name, '.npy') FROM la),
    have AS (SELECT concat('/b/', name, '.png') AS path FROM lb UNION SELECT concat('/t/', name, '.npy') FROM lc)
    SELECT name AS image, label, string_agg(path, ',' ORDER BY path) AS checked FROM need
    LEFT JOIN have USING (path) GROUP BY 1, 2 HAVING NOT bool_or(have.path IS NOT NULL)""",
)
def missing_inputs(spark, folder):
    primary, secondary, pred = _image_lists(spark, folder)

    def path(root: str, ending: str):
        return F.concat(F.lit(f"/{root}/"), F.col("image"), F.lit(ending))

    names = primary.distinct()
    either = F.array(path("a", ".png"), path("b", ".png"))
    required = names.select("image", F.lit("raster").alias("label"), F.explode(either).alias("path")).unionByName(
        names.select("image", F.lit("truth").alias("label"), path("t", ".npy").alias("path"))
    )
    files = secondary.select(path("b", ".png").alias("path")).union(pred.select(path("t", ".npy").alias("path")))
    missing = inventory.missing_inputs(required, files)
    return missing.withColumn("checked", F.array_join("checked", ","))


@query(
    "missing_report",
    f"""WITH {LISTS_SQL}, m AS (SELECT name AS image FROM la EXCEPT SELECT name FROM lb)
    SELECT image, (SELECT count(*) FROM m) AS total FROM m ORDER BY image LIMIT 200""",
)
def missing_report(spark, folder):
    """At most 200 messages are shown, with the number of all."""
    primary, secondary, _ = _image_lists(spark, folder)
    return inventory.message_list(primary.subtract(secondary), ["image"])


@query(
    "match_files",
    """WITH names AS (SELECT concat(c_name, CASE WHEN c_custkey % 3 = 0 THEN '_D' WHEN c_custkey % 3 = 1 THEN '_depth' ELSE '' END) AS name,
                      c_custkey AS k FROM customer),
    files AS (SELECT concat('/rgb/', c_name, CASE WHEN c_custkey % 7 = 1 THEN '_x' ELSE '' END,
                 CASE WHEN c_custkey % 2 = 0 THEN '.png' ELSE '.jpg' END) AS path FROM customer WHERE c_custkey % 5 <> 0
              UNION ALL SELECT concat('/rgb/', c_name, '.JPG') FROM customer WHERE c_custkey % 4 = 0
              UNION ALL SELECT concat('/rgb/', c_name, '.txt') FROM customer WHERE c_custkey % 5 = 0),
    ok AS (SELECT path, substr(path, 6) AS file FROM files WHERE NOT ends_with(path, '.txt')),
    cand AS (SELECT name, unnest([name, replace(name, '_D', ''), replace(name, '_depth', '')]) AS c, unnest([0, 1, 2]) AS i FROM names),
    tried AS (SELECT name, i, concat(c, e) AS file, j FROM cand CROSS JOIN (VALUES ('.jpg', 0), ('.png', 1), ('.JPG', 2)) AS x(e, j)),
    exact AS (SELECT name, arg_min(path, i * 3 + j) AS path FROM tried JOIN ok USING (file) GROUP BY name),
    pre AS (SELECT n.name, min(ok.path) AS path FROM names n JOIN ok ON starts_with(ok.file, replace(n.name, '_depth', ''))
            WHERE n.name NOT IN (SELECT name FROM exact) GROUP BY n.name)
    SELECT n.name, coalesce(e.path, p.path) AS path FROM names n LEFT JOIN exact e USING (name) LEFT JOIN pre p USING (name)""",
)
def match_files(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_name")
    key = F.col("c_custkey")
    ending = F.when(key % 3 == 0, "_D").when(key % 3 == 1, "_depth").otherwise("")
    names = customer.select(F.concat("c_name", ending).alias("name"))

    def path(*parts):
        return F.concat(F.lit("/rgb/"), F.col("c_name"), *parts).alias("path")

    files = (
        customer.filter(key % 5 != 0)
        .select(path(F.when(key % 7 == 1, "_x").otherwise(""), F.when(key % 2 == 0, ".png").otherwise(".jpg")))
        .union(customer.filter(key % 4 == 0).select(path(F.lit(".JPG"))))
        .union(customer.filter(key % 5 == 0).select(path(F.lit(".txt"))))
    )
    return inventory.match_files(names, files, [".jpg", ".png", ".JPG"])
