"""Cameras, projection with nearest depth, hole filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import camera, neighborhood, raster
from workloads import views
from workloads.registry import query, r6, rounded, table

ZBUFFER_SQL = views.POINTS_SQL + "," + views.CAMERAS_SQL + """,
cam AS (SELECT c.*, p.src_file, p.point_idx, p.class,
    r00 * x + r01 * y + r02 * z + t0 AS xc, r10 * x + r11 * y + r12 * z + t1 AS yc, r20 * x + r21 * y + r22 * z + t2 AS zc
  FROM v_points p CROSS JOIN v_cameras c),
hit AS (SELECT camera_id AS image, CAST(trunc(fy * yc / zc + cy) AS BIGINT) AS v, CAST(trunc(fx * xc / zc + cx) AS BIGINT) AS u,
    CAST(zc AS FLOAT) AS depth, class, src_file, point_idx, width, height FROM cam WHERE zc > 0.01e0 AND zc < 1000e0),
z AS (SELECT image, CAST(v AS INT) AS y, CAST(u AS INT) AS x, class AS label, depth,
    row_number() OVER (PARTITION BY image, v, u ORDER BY depth, src_file, point_idx) AS rn
  FROM hit WHERE u >= 0 AND u < width AND v >= 0 AND v < height),
zbuf AS (SELECT image, y, x, label, depth FROM z WHERE rn = 1)"""


def _zbuffer(spark, folder):
    hits = camera.project_points(views.points(spark, folder), views.cameras(spark, folder), 0.01, 1000.0)
    return camera.zbuffer(hits)


def _dims(spark, folder):
    return views.cameras(spark, folder).select("image", "height", "width")


@query("project_zbuffer", f"WITH {ZBUFFER_SQL} SELECT image, y, x, label, depth FROM zbuf")
def project_zbuffer(spark, folder):
    return _zbuffer(spark, folder)


@query(
    "project_counts",
    f"""WITH {ZBUFFER_SQL} SELECT image, count(*) AS hits, count(DISTINCT concat(src_file, '/', CAST(point_idx AS STRING))) AS points FROM hit
    WHERE u >= 0 AND u < width AND v >= 0 AND v < height GROUP BY image""",
)
def project_counts(spark, folder):
    hits = camera.project_points(views.points(spark, folder), views.cameras(spark, folder), 0.01, 1000.0)
    return hits.groupBy("image").agg(F.count("*").alias("hits"), F.count("point_idx").alias("points"))


@query(
    "coverage",
    f"""WITH {ZBUFFER_SQL} SELECT c.camera_id AS image, count(z.y) AS covered, round(count(z.y) / (64e0 * 48e0), 6) AS coverage
    FROM v_cameras c LEFT JOIN zbuf z ON z.image = c.camera_id GROUP BY 1""",
)
def coverage(spark, folder):
    return rounded(camera.coverage(_zbuffer(spark, folder), views.cameras(spark, folder)), "coverage")


@query(
    "camera_center",
    f"""WITH {views.CAMERAS_SQL} SELECT camera_id AS image, round(-(r00 * t0 + r10 * t1 + r20 * t2), 6) AS center_x,
    round(-(r01 * t0 + r11 * t1 + r21 * t2), 6) AS center_y, round(-(r02 * t0 + r12 * t1 + r22 * t2), 6) AS center_z FROM v_cameras""",
)
def camera_center(spark, folder):
    centers = camera.with_center(views.cameras(spark, folder))
    return rounded(centers, "center_x", "center_y", "center_z").select("image", "center_x", "center_y", "center_z")


@query(
    "camera_extent",
    f"""WITH {views.CAMERAS_SQL}, c AS (SELECT -(r00 * t0 + r10 * t1 + r20 * t2) AS x, -(r01 * t0 + r11 * t1 + r21 * t2) AS y,
      -(r02 * t0 + r12 * t1 + r22 * t2) AS z FROM v_cameras),
    m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM c)
    SELECT round(max(mx), 6) AS center_x, round(max(my), 6) AS center_y, round(max(mz), 6) AS center_z,
      round(1.1e0 * max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))), 6) AS radius FROM c, m""",
)
def camera_extent(spark, folder):
    extent = camera.camera_extent(views.cameras(spark, folder))
    return rounded(extent, "center_x", "center_y", "center_z", "radius")


@query(
    "distance_to_camera",
    f"""WITH {views.POINTS_SQL}, {views.CAMERAS_SQL},
    c AS (SELECT -(r00 * t0 + r10 * t1 + r20 * t2) AS cx_, -(r01 * t0 + r11 * t1 + r21 * t2) AS cy_, -(r02 * t0 + r12 * t1 + r22 * t2) AS cz_
          FROM v_cameras WHERE camera_id = 2)
    SELECT src_file, point_idx FROM v_points, c
    WHERE sqrt((x - cx_) * (x - cx_) + (y - cy_) * (y - cy_) + (z - cz_) * (z - cz_)) BETWEEN 5e0 AND 25e0""",
)
def distance_to_camera(spark, folder):
    """Points within a distance range of a reference camera."""
    from rasterloom.plans.projection import near_camera

    kept = near_camera(views.points(spark, folder), views.cameras(spark, folder), "2", 5.0, 25.0)
    return kept.select("src_file", "point_idx")


@query(
    "holdout_split",
    """WITH n AS (SELECT c_name AS image, row_number() OVER (ORDER BY c_name) - 1 AS position FROM customer)
    SELECT image, CAST(position AS INT) AS position, position % 8 = 0 AS is_test FROM n""",
)
def holdout_split(spark, folder):
    names = table(spark, folder, "customer").select(F.col("c_name").alias("image"))
    return camera.holdout_split(names).withColumn("position", F.col("position").cast("int"))


@query(
    "camera_list",
    """WITH n AS (SELECT c_name AS image, (row_number() OVER (ORDER BY c_name) - 1) % 8 = 0 AS is_test FROM customer)
    SELECT image, is_test, CAST(row_number() OVER (ORDER BY NOT is_test, image) - 1 AS INT) AS id FROM n""",
)
def camera_list(spark, folder):
    split = holdout_split(spark, folder).drop("position")
    listed = camera.camera_list(split.filter(~F.col("is_test")), split.filter("is_test"))
    return listed.withColumn("id", F.col("id").cast("int"))


@query(
    "shuffled_cameras",
    "SELECT c_name AS image FROM customer",
)
def shuffled_cameras(spark, folder):
    names = table(spark, folder, "customer").select(F.col("c_name").alias("image"))
    return camera.shuffled(names, seed=3)


@query(
    "resolve_cameras",
    """WITH q AS (SELECT s_suppkey AS k, s_nationkey % 5 + 1 AS w, s_suppkey % 3 AS x, s_suppkey % 4 AS y, s_nationkey % 2 AS z FROM supplier),
    u AS (SELECT k, w / n AS w, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS n FROM q))
    SELECT CAST(k AS STRING) AS image, 320 AS width, 120 AS height,
      round((CASE WHEN n_nationkey % 2 = 0 THEN 100e0 + n_nationkey ELSE 90e0 END) * (320e0 / (640 + n_nationkey)), 6) AS fx,
      round((CASE WHEN n_nationkey % 2 = 0 THEN 110e0 ELSE 90e0 END) * (120e0 / 480e0), 6) AS fy,
      round((CASE WHEN n_nationkey % 2 = 0 THEN 320e0 ELSE 321e0 END) * (320e0 / (640 + n_nationkey)), 6) AS cx,
      round((CASE WHEN n_nationkey % 2 = 0 THEN 240e0 ELSE 241e0 END) * (120e0 / 480e0), 6) AS cy,
      round(1 - 2 * y * y - 2 * z * z, 6) AS r00, round(2 * x * y - 2 * w * z, 6) AS r01, round(2 * z * x + 2 * w * y, 6) AS r02,
      round(2 * x * y + 2 * w * z, 6) AS r10, round(1 - 2 * x * x - 2 * z * z, 6) AS r11, round(2 * y * z - 2 * w * x, 6) AS r12,
      round(2 * z * x - 2 * w * y, 6) AS r20, round(2 * y * z + 2 * w * x, 6) AS r21, round(1 - 2 * x * x - 2 * y * y, 6) AS r22,
      s_acctbal AS t0
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN u ON u.k = s_suppkey""",
)
def resolve_cameras(spark, folder):
    """Poses made from suppliers, intrinsics from nations, rescaled to 320 x 120."""
    nation, key = F.col("n_nationkey"), F.col("s_suppkey")
    lens = table(spark, folder, "nation").select(
        nation.alias("camera_id"),
        F.when(nation % 2 == 0, "PINHOLE").otherwise("SIMPLE_PINHOLE").alias("model"),
        (F.lit(640) + nation).alias("width"),
        F.lit(480).alias("height"),
        F.when(
            nation % 2 == 0, F.array(F.lit(100.0) + nation, F.lit(110.0), F.lit(320.0), F.lit(240.0))
        )
        .otherwise(F.array(F.lit(90.0), F.lit(321.0), F.lit(241.0)))
        .alias("params"),
    )
    raw = [F.col("s_nationkey") % 5 + 1, key % 3, key % 4, F.col("s_nationkey") % 2]
    size = F.sqrt((raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2] + raw[3] * raw[3]).cast("double"))
    poses = table(spark, folder, "supplier").select(
        key.cast("string").alias("name"),
        F.col("s_nationkey").alias("camera_id"),
        F.array(*[c / size for c in raw]).alias("qvec"),
        F.array(F.col("s_acctbal"), F.lit(0.0), F.lit(0.0)).alias("tvec"),
    )
    resolved = camera.resolve_cameras(poses, lens, 320, 120).drop("t1", "t2")
    return rounded(resolved, "fx", "fy", "cx", "cy", *camera.ROTATION)


@query(
    "find_camera",
    """WITH cams AS (SELECT concat(c_name, CASE WHEN c_custkey % 2 = 0 THEN '.JPG' ELSE '.png' END) AS image, c_custkey AS k FROM customer),
    w AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, '.JPG') ELSE concat(c_name, '.tif') END AS name, c_name FROM customer)
    SELECT w.name, coalesce(a.image, b.image) AS image, coalesce(a.k, b.k) AS k FROM w LEFT JOIN cams a ON a.image = w.name
    LEFT JOIN cams b ON regexp_replace(b.image, '\\.[^.]*$', '') = w.c_name""",
)
def find_camera(spark, folder):
    key = F.col("c_custkey")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name")
    cams = customer.select(
        F.concat("c_name", F.when(key % 2 == 0, ".JPG").otherwise(".png")).alias("image"), key.alias("k")
    )
    wanted = customer.select(F.concat("c_name", F.when(key % 3 == 0, ".JPG").otherwise(".tif")).alias("name"))
    return camera.find_camera(cams, wanted)


# --- filling ----------------------------------------------------------------------

RADIUS = 3


def _fill_sql(source: str) -> str:
    """Nearest source within the radius, then smallest row and column, by brute force."""
    reach = f"generate_series(-{RADIUS}, {RADIUS})"
    return f"""
offsets AS (SELECT dy, dx FROM (SELECT unnest({reach}) AS dy) a, (SELECT unnest({reach}) AS dx) b WHERE dy * dy + dx * dx <= {RADIUS * RADIUS}),
cand AS (SELECT s.image, s.y + o.dy AS y, s.x + o.dx AS x, s.label, o.dy * o.dy + o.dx * o.dx AS d2, s.y AS sy, s.x AS sx
  FROM {source} s CROSS JOIN offsets o),
filled AS (SELECT image, y, x, arg_min(label, d2 * 1000000 + sy * 1000 + sx) AS label FROM cand
  WHERE y >= 0 AND x >= 0 AND y < 48 AND x < 64 AND NOT EXISTS (SELECT 1 FROM zbuf z WHERE z.image = cand.image AND z.y = cand.y AND z.x = cand.x)
  GROUP BY image, y, x),
full_ AS (SELECT image, y, x, label, false AS filled FROM zbuf
  UNION ALL SELECT image, CAST(y AS INT), CAST(x AS INT), label, true FROM filled)"""


@query("fill_nearest", f"WITH {ZBUFFER_SQL}, {_fill_sql('zbuf')} SELECT * FROM full_")
def fill_nearest(spark, folder):
    return neighborhood.fill_nearest(_zbuffer(spark, folder), _dims(spark, folder), RADIUS, tile=32)


# A dense depth raster: the given orders laid out as pixels, with some left out.
DEPTH_SQL = views.RASTER_SQL + """,
dense AS (SELECT image, y, x, primary_label AS label, CAST(10 + (y // 5) * 3 + (x // 4) + (y * 7 + x * 3) % 5 / 8e0 AS FLOAT) AS depth
  FROM v_raster WHERE NOT (y % 9 = 4 AND x % 6 = 2) AND NOT (y % 15 > 10 AND x > 14)),
dd AS (SELECT image, max(y) + 1 AS height, 20 AS width FROM v_raster GROUP BY image)"""

EDGE_SQL = DEPTH_SQL + """,
n9 AS (SELECT c.image, c.y, c.x, CAST(n.depth AS DOUBLE) AS d, n.y - c.y AS dy, n.x - c.x AS dx
  FROM dense c JOIN dense n ON n.image = c.image AND n.y BETWEEN c.y - 2 AND c.y + 2 AND n.x BETWEEN c.x - 2 AND c.x + 2),
st AS (SELECT image, y, x, max(d) AS top, count(*) FILTER (WHERE abs(dy) < 2 AND abs(dx) < 2) AS covered,
    coalesce(sum(d * dx * (2 - abs(dy))) FILTER (WHERE abs(dy) < 2 AND abs(dx) < 2), 0) AS gx,
    coalesce(sum(d * dy * (2 - abs(dx))) FILTER (WHERE abs(dy) < 2 AND abs(dx) < 2), 0) AS gy FROM n9 GROUP BY 1, 2, 3),
e0 AS (SELECT st.image, st.y, st.x FROM st JOIN dd USING (image) WHERE covered = (least(y + 1, height - 1) - greatest(y - 1, 0) + 1) *
    (least(x + 1, width - 1) - greatest(x - 1, 0) + 1) AND sqrt(gx * gx + gy * gy) / top > 0.75e0),
e1 AS (SELECT DISTINCT image, y + oy AS y, x + ox AS x FROM e0, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(oy, ox)),
flagged AS (SELECT d.*, e1.y IS NOT NULL AS edge FROM dense d LEFT JOIN e1 USING (image, y, x))"""


def _dense_depth(spark, folder):
    y, x = F.col("y"), F.col("x")
    rasters = views.raster(spark, folder)
    level = (
        F.lit(10) + F.floor(y / F.lit(5)) * 3 + F.floor(x / F.lit(4)) + (y * 7 + x * 3) % 5 / F.lit(8.0)
    )
    dense = rasters.filter(~((y % 9 == 4) & (x % 6 == 2)) & ~((y % 15 > 10) & (x > 14))).select(
        "image", "y", "x", F.col("primary_label").alias("label"), level.cast("float").alias("depth")
    )
    return dense, views.raster_dims(rasters)


@query("depth_edges", f"WITH {EDGE_SQL} SELECT image, y, x, label, depth, edge FROM flagged")
def depth_edges(spark, folder):
    return neighborhood.flag_depth_edges(*_dense_depth(spark, folder), threshold=0.75, tile=64)


@query(
    "fill_edge_aware",
    f"""WITH {EDGE_SQL},
    offsets AS (SELECT dy, dx FROM (SELECT unnest(generate_series(-2, 2)) AS dy) a, (SELECT unnest(generate_series(-2, 2)) AS dx) b WHERE dy * dy + dx * dx <= 4),
    cand AS (SELECT s.image, s.y + o.dy AS y, s.x + o.dx AS x, s.label, o.dy * o.dy + o.dx * o.dx AS d2, s.y AS sy, s.x AS sx
      FROM flagged s CROSS JOIN offsets o WHERE NOT s.edge),
    hole AS (SELECT c.image, c.y, c.x, arg_min(c.label, d2 * 10000000 + sy * 1000 + sx) AS label FROM cand c JOIN dd USING (image)
      LEFT JOIN dense z USING (image, y, x) WHERE z.depth IS NULL AND c.y >= 0 AND c.x >= 0 AND c.y < height AND c.x < width GROUP BY 1, 2, 3)
    SELECT image, y, x, label, false AS filled FROM dense UNION ALL SELECT image, CAST(y AS INT), CAST(x AS INT), label, true FROM hole""",
)
def fill_edge_aware(spark, folder):
    dense, dims = _dense_depth(spark, folder)
    return neighborhood.fill_edge_aware(dense, dims, radius=2, threshold=0.75, tile=64)


@query(
    "coverage_after_fill",
    f"""WITH {ZBUFFER_SQL}, {_fill_sql('zbuf')},
    per AS (SELECT c.camera_id AS image, count(f.y) FILTER (WHERE NOT f.filled) / (64e0 * 48e0) AS b, count(f.y) / (64e0 * 48e0) AS a
      FROM v_cameras c LEFT JOIN full_ f ON f.image = c.camera_id GROUP BY 1)
    SELECT count(*) AS n_images, round(avg(b), 6) AS coverage_before, round(avg(a), 6) AS coverage_after FROM per""",
)
def coverage_after_fill(spark, folder):
    from rasterloom.plans.projection import projection_stats

    cams = views.cameras(spark, folder)
    filled = neighborhood.fill_nearest(_zbuffer(spark, folder), _dims(spark, folder), RADIUS)
    per_image, _ = projection_stats(filled, cams)
    return per_image.agg(
        F.count("*").alias("n_images"),
        r6(F.avg("coverage_before")).alias("coverage_before"),
        r6(F.avg("coverage_after")).alias("coverage_after"),
    )


@query(
    "projection_class_histogram",
    f"""WITH {ZBUFFER_SQL}, {_fill_sql('zbuf')} SELECT image, label, count(*) AS n FROM full_ GROUP BY 1, 2""",
)
def projection_class_histogram(spark, folder):
    from rasterloom.plans.projection import projection_stats

    filled = neighborhood.fill_nearest(_zbuffer(spark, folder), _dims(spark, folder), RADIUS)
    return projection_stats(filled, views.cameras(spark, folder))[1]
