"""Point clouds: moving, sampling, counting."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import crs
from rasterloom.operators import knn, points, sampling, splats
from workloads import views
from workloads.registry import query, r6, rounded, table

RATES = {1: 0.05, 2: 0.15, 3: 0.9, 4: 1.7}
DEFAULT_RATE = 0.1

# An arithmetic stand-in for the random key that both engines can compute.
KEY_BITS = 20
KEY_SQL = "((point_idx * 7919 + 104729) % 1000003)"


def _key():
    return (F.col("point_idx") * 7919 + 104729) % 1000003


@query(
    "translate",
    f"WITH {views.POINTS_SQL} SELECT src_file, point_idx, x + 690826e0 AS x, y + 5335877e0 AS y, z + 500e0 AS z, class FROM v_points",
)
def translate(spark, folder):
    return points.translate(views.points(spark, folder), 690826.0, 5335877.0, 500.0)


@query(
    "affine",
    f"""WITH {views.POINTS_SQL} SELECT src_file, point_idx, round(x * 2e0 - 435158e0, 6) AS x, round(y * 5e-1 - 4593748e0, 6) AS y,
    round(z * 0.3048e0 * 3e0 - 316e0 + 25e-1, 6) AS z, class FROM v_points""",
)
def affine(spark, folder):
    moved = points.affine(
        views.points(spark, folder),
        scale=(2.0, 0.5, 3.0),
        shift=(-435158.0, -4593748.0, -316.0),
        extra_z=2.5,
    )
    return rounded(moved, "x", "y", "z")


@query(
    "frame_shift",
    f"""WITH {views.POINTS_SQL} SELECT src_file, CAST(point_idx AS BIGINT) AS point_idx,
    CAST(x + 690826e0 - 690955e0 AS FLOAT) AS x, CAST(y + 5335877e0 - 5336042e0 AS FLOAT) AS y,
    CAST(z + 500e0 - 604e0 AS FLOAT) AS z FROM v_points""",
)
def frame_shift(spark, folder):
    """Doubles inside, single precision at the end."""
    moved = points.translate(views.points(spark, folder), 690826.0, 5335877.0, 500.0)
    shifted = points.frame_shift(moved, (-690955.0, -5336042.0, -604.0))
    return shifted.select("src_file", "point_idx", *[F.col(a).cast("float").alias(a) for a in "xyz"])


@query(
    "distance_filter",
    f"""WITH {views.POINTS_SQL} SELECT src_file, point_idx FROM v_points
    WHERE sqrt((x - 5e0) * (x - 5e0) + (y - 3e0) * (y - 3e0) + (z - 10e0) * (z - 10e0)) BETWEEN 4e0 AND 20e0""",
)
def distance_filter(spark, folder):
    return points.filter_by_distance(views.points(spark, folder), (5.0, 3.0, 10.0), 4.0, 20.0).select(
        "src_file", "point_idx"
    )


@query(
    "class_histogram",
    f"""WITH {views.POINTS_SQL} SELECT class, count(*) AS n, round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS "percent"
    FROM v_points GROUP BY class""",
)
def class_histogram(spark, folder):
    return rounded(points.class_histogram(views.points(spark, folder)), "percent")


@query(
    "class_histogram_by_file",
    f"""WITH {views.POINTS_SQL} SELECT src_file, class, count(*) AS n,
    round(count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY src_file), 6) AS "percent" FROM v_points GROUP BY src_file, class""",
)
def class_histogram_by_file(spark, folder):
    return rounded(points.class_histogram(views.points(spark, folder), ["src_file"]), "percent")


@query(
    "bounds",
    f"""WITH {views.POINTS_SQL} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y,
    min(z) AS min_z, max(z) AS max_z FROM v_points""",
)
def bounds(spark, folder):
    return points.bounds(views.points(spark, folder))


@query("point_count", f"WITH {views.POINTS_SQL} SELECT src_file, count(*) AS n_points FROM v_points GROUP BY src_file")
def point_count(spark, folder):
    return points.point_count(views.points(spark, folder))


VOXEL_SQL = """
voxel AS (SELECT *, row_number() OVER (PARTITION BY floor(x / 4e0), floor(y / 4e0), floor(z / 4e0)
          ORDER BY class, src_file, point_idx) AS rn FROM v_points)"""


@query(
    "voxel_downsample",
    f"WITH {views.POINTS_SQL}, {VOXEL_SQL} SELECT src_file, point_idx, x, y, z, class FROM voxel WHERE rn = 1",
)
def voxel_downsample(spark, folder):
    return sampling.voxel_downsample(views.points(spark, folder), 4.0)


@query(
    "voxel_downsample_chunked",
    f"""WITH {views.POINTS_SQL}, c AS (SELECT *, point_idx // 2000 AS chunk FROM v_points),
    v AS (SELECT *, row_number() OVER (PARTITION BY src_file, chunk, floor(x / 8e0), floor(y / 8e0), floor(z / 8e0)
          ORDER BY class, point_idx) AS rn FROM c)
    SELECT src_file, point_idx, chunk, class FROM v WHERE rn = 1""",
)
def voxel_downsample_chunked(spark, folder):
    chunked = views.points(spark, folder).withColumn("chunk", sampling.chunk_number(2000))
    return sampling.voxel_downsample(chunked, 8.0, scope=["src_file", "chunk"]).select(
        "src_file", "point_idx", "chunk", "class"
    )


@query(
    "voxel_downsample_rare",
    f"""WITH {views.POINTS_SQL}, n AS (SELECT class, count(*) AS n FROM v_points GROUP BY class),
    v AS (SELECT src_file, point_idx, class, row_number() OVER (PARTITION BY floor(x / 4e0), floor(y / 4e0), floor(z / 4e0)
          ORDER BY n, class, src_file, point_idx) AS rn FROM v_points JOIN n USING (class))
    SELECT src_file, point_idx, class FROM v WHERE rn = 1""",
)
def voxel_downsample_rare(spark, folder):
    return sampling.voxel_downsample(views.points(spark, folder), 4.0, prefer="rare").select(
        "src_file", "point_idx", "class"
    )


RATE_SQL = "CASE class WHEN 1 THEN 0.05e0 WHEN 2 THEN 0.15e0 WHEN 3 THEN 0.9e0 WHEN 4 THEN 1e0 ELSE 0.1e0 END"


@query(
    "class_quota",
    f"""WITH {views.POINTS_SQL}, r AS (SELECT src_file, point_idx, class,
      row_number() OVER (PARTITION BY class ORDER BY {KEY_SQL}, src_file, point_idx) AS rn,
      count(*) OVER (PARTITION BY class) AS n FROM v_points)
    SELECT src_file, point_idx, class FROM r WHERE rn <= floor(n * {RATE_SQL})""",
)
def class_quota(spark, folder):
    kept = sampling.class_aware_sample(
        views.points(spark, folder), RATES, DEFAULT_RATE, key=_key(), key_bits=KEY_BITS
    )
    return kept.select("src_file", "point_idx", "class")


@query(
    "class_quota_chunked",
    f"""WITH {views.POINTS_SQL}, c AS (SELECT *, point_idx // 2000 AS chunk FROM v_points),
    r AS (SELECT src_file, point_idx, class, row_number() OVER (PARTITION BY src_file, chunk, class ORDER BY {KEY_SQL}, point_idx) AS rn,
      count(*) OVER (PARTITION BY src_file, chunk, class) AS n FROM c)
    SELECT src_file, point_idx, class FROM r WHERE rn <= floor(n * {RATE_SQL})""",
)
def class_quota_chunked(spark, folder):
    chunked = views.points(spark, folder).withColumn("chunk", sampling.chunk_number(2000))
    kept = sampling.class_aware_sample(
        chunked, RATES, DEFAULT_RATE, key=_key(), key_bits=KEY_BITS, scope=["src_file", "chunk"]
    )
    return kept.select("src_file", "point_idx", "class")


@query(
    "uniform_quota",
    f"""WITH {views.POINTS_SQL}, r AS (SELECT src_file, point_idx, row_number() OVER (ORDER BY {KEY_SQL}, src_file, point_idx) AS rn,
      count(*) OVER () AS n FROM v_points)
    SELECT src_file, point_idx FROM r WHERE rn <= floor(n * 0.2e0)""",
)
def uniform_quota(spark, folder):
    kept = sampling.uniform_sample(views.points(spark, folder), 0.2, key=_key(), key_bits=KEY_BITS)
    return kept.select("src_file", "point_idx")


@query(
    "uniform_quota_random",
    f"""WITH {views.POINTS_SQL} SELECT CAST(floor(count(*) * 0.2e0) AS BIGINT) AS n, true AS all_known FROM v_points""",
)
def uniform_quota_random(spark, folder):
    """With the seeded key: exactly the quota, and only rows of the input."""
    cloud = views.points(spark, folder)
    kept = sampling.uniform_sample(cloud, 0.2, seed=7)
    known = kept.join(cloud, ["src_file", "point_idx"], "left_semi").agg(F.count("*").alias("k")).scalar()
    return kept.agg(F.count("*").alias("n")).select("n", (F.col("n") == known).alias("all_known"))


@query(
    "voxel_then_class_quota",
    f"""WITH {views.POINTS_SQL}, {VOXEL_SQL},
    r AS (SELECT src_file, point_idx, class, row_number() OVER (PARTITION BY class ORDER BY {KEY_SQL}, src_file, point_idx) AS rank,
      count(*) OVER (PARTITION BY class) AS n FROM voxel WHERE rn = 1)
    SELECT src_file, point_idx, class FROM r WHERE rank <= floor(n * {RATE_SQL})""",
)
def voxel_then_class_quota(spark, folder):
    kept = sampling.downsample(
        views.points(spark, folder),
        "voxel+class_aware",
        voxel_size=4.0,
        rates=RATES,
        default_rate=DEFAULT_RATE,
        key=_key(),
        key_bits=KEY_BITS,
    )
    return kept.select("src_file", "point_idx", "class")


KEPT_SQL = f"""
kept AS (SELECT src_file, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {KEY_SQL}, src_file, point_idx) AS rn,
      count(*) OVER (PARTITION BY class) AS n FROM v_points) WHERE rn <= floor(n * {RATE_SQL})),
marked AS (SELECT src_file, class, 1 AS o, 0 AS k FROM v_points UNION ALL SELECT src_file, class, 0, 1 FROM kept)"""


@query(
    "retention_rollup",
    f"""WITH {views.POINTS_SQL}, {KEPT_SQL}
    SELECT src_file, class, CAST(sum(o) AS BIGINT) AS n_original, CAST(sum(k) AS BIGINT) AS n_kept,
      round(sum(k) / sum(o), 6) AS rate FROM marked GROUP BY ROLLUP (src_file, class)""",
)
def retention_rollup(spark, folder):
    cloud = views.points(spark, folder)
    kept = sampling.class_aware_sample(cloud, RATES, DEFAULT_RATE, key=_key(), key_bits=KEY_BITS)
    return rounded(points.retention_stats(cloud, kept), "rate")


@query(
    "class_retention",
    f"""WITH {views.POINTS_SQL}, {KEPT_SQL}
    SELECT class, CAST(sum(o) AS BIGINT) AS n_original, CAST(sum(k) AS BIGINT) AS n_kept,
      round(100e0 * sum(k) / sum(o), 6) AS "percent" FROM marked GROUP BY class""",
)
def class_retention(spark, folder):
    cloud = views.points(spark, folder)
    kept = sampling.class_aware_sample(cloud, RATES, DEFAULT_RATE, key=_key(), key_bits=KEY_BITS)
    return rounded(points.class_retention(cloud, kept), "percent")


# Two zones of one transverse Mercator system and a two-parallel conic, in feet.
ZONE_A = crs.TransverseMercator(lon0=9.0)
ZONE_B = crs.TransverseMercator(lon0=15.0)
ZONE_FAR = crs.TransverseMercator(lon0=-81.0)
CONIC = crs.LambertConic(
    lon0=-84.36666666666666,
    lat0=41.5,
    lat1=43.66666666666666,
    lat2=42.1,
    false_east=4_000_000.0,
    unit=0.3048,
)


@query(
    "reproject_round_trip",
    f"WITH {views.POINTS_SQL} SELECT src_file, point_idx, round(x + 690826e0, 4) AS x, round(y + 5335877e0, 4) AS y FROM v_points",
)
def reproject_round_trip(spark, folder):
    """To the neighbouring zone, through geographic coordinates, and back."""
    cloud = points.translate(views.points(spark, folder), 690826.0, 5335877.0, 500.0)
    back = crs.reproject_xy(crs.reproject_xy(cloud, ZONE_A, ZONE_B), ZONE_B, ZONE_A)
    return back.select("src_file", "point_idx", *[F.round(a, 4).alias(a) for a in "xy"])


@query(
    "reproject_conic_round_trip",
    f"WITH {views.POINTS_SQL} SELECT src_file, point_idx, round(x + 13e6, 3) AS x, round(y + 5e5, 3) AS y FROM v_points",
)
def reproject_conic_round_trip(spark, folder):
    cloud = points.translate(views.points(spark, folder), 13e6, 5e5, 0.0)
    back = crs.reproject_xy(crs.reproject_xy(cloud, CONIC, ZONE_FAR), ZONE_FAR, CONIC)
    return back.select("src_file", "point_idx", *[F.round(a, 3).alias(a) for a in "xy"])


# --- splats -----------------------------------------------------------------------

SPLATS_SQL = views.POINTS_SQL + """,
splats AS (SELECT point_idx, (class - 3) / 2e0 AS o, (x / 40e0) AS s0, (y / 40e0) AS s1, (z / 40e0) AS s2,
  1e0 AS q0, (class * 1e0) AS q1, (x / 10e0) AS q2, (z / 10e0) AS q3 FROM v_points),
act AS (SELECT point_idx, 1 / (1 + exp(-o)) AS opacity, exp(s0) AS s0, exp(s1) AS s1, exp(s2) AS s2,
  q0 / n AS q0, q1 / n AS q1, q2 / n AS q2, q3 / n AS q3
  FROM (SELECT *, sqrt(q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3) AS n FROM splats))"""


def _splats(spark, folder):
    cloud = views.points(spark, folder)
    return cloud.select(
        "point_idx",
        ((F.col("class") - 3) / F.lit(2.0)).alias("opacity"),
        F.array(*[F.col(a) / F.lit(40.0) for a in "xyz"]).alias("scale"),
        F.array(
            F.lit(1.0), F.col("class") * F.lit(1.0), F.col("x") / F.lit(10.0), F.col("z") / F.lit(10.0)
        ).alias("rot"),
    )


@query(
    "splat_activate",
    f"""WITH {SPLATS_SQL} SELECT point_idx, round(opacity, 6) AS opacity, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2,
    round(q0, 6) AS q0, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3 FROM act""",
)
def splat_activate(spark, folder):
    active = splats.activate(_splats(spark, folder))
    return active.select(
        "point_idx",
        r6("opacity").alias("opacity"),
        *[r6(F.col("scale")[i]).alias(f"s{i}") for i in range(3)],
        *[r6(F.col("rot")[i]).alias(f"q{i}") for i in range(4)],
    )


@query(
    "splat_covariance",
    f"""WITH {SPLATS_SQL}, r AS (SELECT *, 1 - 2 * q2 * q2 - 2 * q3 * q3 AS a, 2 * q1 * q2 - 2 * q0 * q3 AS b, 2 * q1 * q3 + 2 * q0 * q2 AS c,
      2 * q1 * q2 + 2 * q0 * q3 AS d, 1 - 2 * q1 * q1 - 2 * q3 * q3 AS e, 2 * q2 * q3 - 2 * q0 * q1 AS f,
      2 * q1 * q3 - 2 * q0 * q2 AS g, 2 * q2 * q3 + 2 * q0 * q1 AS h, 1 - 2 * q1 * q1 - 2 * q2 * q2 AS i FROM act)
    SELECT point_idx, round(a * a * s0 * s0 + b * b * s1 * s1 + c * c * s2 * s2, 5) AS xx,
           round(a * d * s0 * s0 + b * e * s1 * s1 + c * f * s2 * s2, 5) AS xy,
           round(a * g * s0 * s0 + b * h * s1 * s1 + c * i * s2 * s2, 5) AS xz,
           round(d * d * s0 * s0 + e * e * s1 * s1 + f * f * s2 * s2, 5) AS yy,
           round(d * g * s0 * s0 + e * h * s1 * s1 + f * i * s2 * s2, 5) AS yz,
           round(g * g * s0 * s0 + h * h * s1 * s1 + i * i * s2 * s2, 5) AS zz FROM r""",
)
def splat_covariance(spark, folder):
    cov = splats.covariance(splats.activate(_splats(spark, folder)))
    return cov.select(
        "point_idx", *[F.round(F.col("cov")[i], 5).alias(n) for i, n in enumerate(("xx", "xy", "xz", "yy", "yz", "zz"))]
    )


@query(
    "splat_prune",
    f"WITH {SPLATS_SQL} SELECT point_idx FROM act WHERE opacity >= 0.4e0 AND greatest(s0, s1, s2) <= 0.1e0 * 20e0",
)
def splat_prune(spark, folder):
    return splats.prune(splats.activate(_splats(spark, folder)), 0.4, 20.0).select("point_idx")


@query(
    "initial_scale",
    """WITH p AS (SELECT s_suppkey AS k, (s_suppkey * 37 % 101) / 1e1 AS x, (s_suppkey * 53 % 97) / 1e1 AS y, s_nationkey * 1e0 AS z FROM supplier),
    d AS (SELECT x, y, z, count(*) AS copies FROM p GROUP BY x, y, z),
    pairs AS (SELECT a.x, a.y, a.z, a.copies, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2,
      row_number() OVER (PARTITION BY a.x, a.y, a.z ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS rn
      FROM d a, p b)
    SELECT x, y, z, copies, round(greatest(avg(d2), 1e-7), 6) AS mean_sq FROM pairs WHERE rn BETWEEN 2 AND 4 GROUP BY x, y, z, copies""",
)
def initial_scale(spark, folder):
    """Mean squared distance to the three nearest others; copies are at distance 0."""
    key = F.col("s_suppkey")
    cloud = table(spark, folder, "supplier").select(
        (key * 37 % 101 / F.lit(10.0)).alias("x"),
        (key * 53 % 97 / F.lit(10.0)).alias("y"),
        (F.col("s_nationkey") * F.lit(1.0)).alias("z"),
    )
    return rounded(knn.initial_scale(cloud, cell=1.0), "mean_sq")


@query(
    "composite_alpha",
    """SELECT o_orderkey AS pixel, round((o_custkey % 256) / 255e0 * ((o_orderkey % 11) / 10e0) + 1e0 * (1 - (o_orderkey % 11) / 10e0), 6) AS r,
      round((o_custkey % 97) / 96e0 * ((o_orderkey % 11) / 10e0) + 1e0 * (1 - (o_orderkey % 11) / 10e0), 6) AS g,
      round((o_custkey % 31) / 30e0 * ((o_orderkey % 11) / 10e0) + 1e0 * (1 - (o_orderkey % 11) / 10e0), 6) AS b
    FROM orders""",
)
def composite_alpha(spark, folder):
    orders = table(spark, folder, "orders")
    pixels = orders.select(
        F.col("o_orderkey").alias("pixel"),
        *[(F.col("o_custkey") % n / F.lit(n - 1.0)).alias(c) for c, n in (("r", 256), ("g", 97), ("b", 31))],
        (F.col("o_orderkey") % 11 / F.lit(10.0)).alias("a"),
    )
    return rounded(splats.composite_alpha(pixels, 1.0), "r", "g", "b").select("pixel", "r", "g", "b")
