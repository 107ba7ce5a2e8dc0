"""Round trips: tables derived from the given ones are stored by a sink, read back by a source, and compared."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators import camera, metrics
from rasterloom.operators.points import frame_shift
from rasterloom.plans.evaluate import EvaluationConfig, evaluate
from rasterloom.plans.run import RunConfig, run_evaluation
from rasterloom.session import work_folder
from rasterloom.sinks import npy, ordered, ply, tables
from rasterloom.plans import projection
from rasterloom.sources import configs, points, rasters, records, scenes
from workloads import views
from workloads.metric_queries import CLASS_COUNTS_SQL, _class_scores
from workloads.registry import query, r6, rounded, table


def _lines(df: DataFrame, target: str) -> str:
    """One column of text stored as lines; returns the folder."""
    df.write.text(target)
    return target


def _object(df: DataFrame, key: str, value, target: str) -> str:
    """A table of bounded size as one JSON object in one line of one file."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), value.alias("v"))))
    one = df.agg(F.to_json(F.map_from_entries(entries)).alias("value"))
    return _lines(one, target)


def _entries(df: DataFrame, key: str, value, target: str) -> str:
    """A table of any size as JSON objects, one entry a line, stored by the tasks that have the rows."""
    return _lines(df.select(F.to_json(F.create_map(F.col(key).cast("string"), value)).alias("value")), target)


# --- point files ------------------------------------------------------------------


@query(
    "ply_points_round_trip",
    f"""WITH {views.POINTS_SQL} SELECT round(CAST(CAST(x AS FLOAT) AS DOUBLE), 4) AS x, round(CAST(CAST(y AS FLOAT) AS DOUBLE), 4) AS y,
    round(CAST(CAST(z AS FLOAT) AS DOUBLE), 4) AS z, class FROM v_points""",
)
def ply_points_round_trip(spark, folder):
    """Tiles of 5,000 rows, so a table is read from many files."""
    target = work_folder(spark, "ply-points")
    cloud = views.points(spark, folder)
    records.register(spark)
    ply.write_points(cloud, target, tile_rows=5000)
    back = points.read_points(spark, target, "ply")
    return back.select(*[F.round(a, 4).alias(a) for a in "xyz"], "class")


@query(
    "multi_file_read",
    f"WITH {views.POINTS_SQL} SELECT src_file, count(*) AS n_points, count(*) AS n_ids FROM v_points GROUP BY src_file",
)
def multi_file_read(spark, folder):
    """Files of the same names in three folders stay apart: every (file, record) occurs once."""
    records.register(spark)
    target, cloud = work_folder(spark, "many-files"), views.points(spark, folder)
    for name in ("f0", "f1", "f2"):
        ply.write_points(cloud.filter(F.col("src_file") == name), f"{target}/{name}", tile_rows=1000)
    back = points.read_points(spark, target, "ply").withColumn("folder", F.split("src_file", "/")[0])
    return back.groupBy(F.col("folder").alias("src_file")).agg(
        F.count("*").alias("n_points"), F.count_distinct(F.struct("src_file", "point_idx")).alias("n_ids")
    )


@query("header_counts", "SELECT count(*) AS n_points, true AS listed FROM orders")
def header_counts(spark, folder):
    """The sum of the counts that file headers state, and a listing of the same files."""
    records.register(spark)
    target = work_folder(spark, "counts")
    ply.write_points(views.points(spark, folder), target, tile_rows=3000)
    n = points.count_points(spark, target, "ply")
    files = points.list_inputs(spark, target, [".ply"])
    return files.groupBy().agg(F.lit(n).cast("long").alias("n_points"), (F.count("*") > 0).alias("listed"))


@query(
    "ply_colored_round_trip",
    """SELECT CAST(o_orderkey AS DOUBLE) AS x, round((o_custkey % 256) / 255e0, 6) AS r, round((o_orderkey % 256) / 255e0, 6) AS g,
    round((o_custkey % 7) / 255e0, 6) AS b, 0e0 AS nx FROM orders""",
)
def ply_colored_round_trip(spark, folder):
    """Every order; x, y and z hold 20 bits of its key each, as single precision holds whole numbers up to 2^24."""
    records.register(spark)
    target = work_folder(spark, "ply-colored")
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").bitwiseAND(0xFFFFF).alias("x"),
        F.shiftright("o_orderkey", 20).bitwiseAND(0xFFFFF).alias("y"),
        F.shiftright("o_orderkey", 40).alias("z"),
        (F.col("o_custkey") % 256).cast("int").alias("r"),
        (F.col("o_orderkey") % 256).cast("int").alias("g"),
        (F.col("o_custkey") % 7).cast("int").alias("b"),
    )
    ply.write_colored(rows, target, tile_rows=5000)
    x, y, z = (F.col(a).cast("long") for a in "xyz")
    key = (F.shiftleft(z, 40) + F.shiftleft(y, 20) + x).cast("double")
    return rounded(points.read_colored(spark, target).select(key.alias("x"), "r", "g", "b", "nx"), "r", "g", "b")


@query(
    "ply_splats_round_trip",
    f"""WITH {views.POINTS_SQL}, s AS (SELECT CAST(x AS FLOAT) AS x, CAST((class - 3) / 2e0 AS FLOAT) AS opacity, CAST(z / 4e1 AS FLOAT) AS s2,
      CAST(y / 1e1 AS FLOAT) AS q3, CAST(x / 5e0 AS FLOAT) AS dc0, CAST(y / 5e0 AS FLOAT) AS rest8 FROM v_points)
    SELECT round(CAST(x AS DOUBLE), 4) AS x, round(CAST(opacity AS DOUBLE), 4) AS opacity, round(CAST(s2 AS DOUBLE), 4) AS s2,
      round(CAST(q3 AS DOUBLE), 4) AS q3, round(CAST(dc0 AS DOUBLE), 4) AS dc0, round(CAST(rest8 AS DOUBLE), 4) AS rest8, 9 AS n_rest FROM s""",
)
def ply_splats_round_trip(spark, folder):
    records.register(spark)
    target, cloud = work_folder(spark, "ply-splats"), views.points(spark, folder)
    zero = F.lit(0.0)
    rows = cloud.select(
        *"xyz",
        F.array(F.col("x") / F.lit(5.0), zero, zero).alias("f_dc"),
        F.array(*[zero] * 8, F.col("y") / F.lit(5.0)).alias("f_rest"),
        ((F.col("class") - 3) / F.lit(2.0)).alias("opacity"),
        F.array(zero, zero, F.col("z") / F.lit(40.0)).alias("scale"),
        F.array(zero, zero, zero, F.col("y") / F.lit(10.0)).alias("rot"),
    )
    ply.write_splats(rows, target, degree=1, tile_rows=5000)
    back = points.read_splats(spark, target, degree=1)

    def r4(value):
        return F.round(value.cast("double"), 4)

    return back.select(
        r4(F.col("x")).alias("x"),
        r4(F.col("opacity")).alias("opacity"),
        r4(F.col("scale")[2]).alias("s2"),
        r4(F.col("rot")[3]).alias("q3"),
        r4(F.col("f_dc")[0]).alias("dc0"),
        r4(F.col("f_rest")[8]).alias("rest8"),
        F.size("f_rest").alias("n_rest"),
    )


# --- rasters ----------------------------------------------------------------------


@query(
    "label_rasters_round_trip",
    f"WITH {views.RASTER_SQL} SELECT image, y, x, primary_label AS label FROM v_raster WHERE primary_label >= 0 AND image IN (1, 4)",
)
def label_rasters_round_trip(spark, folder):
    """All images are stored; two of them are read by name."""
    target = work_folder(spark, "label-rasters")
    tables.write_label_rasters(views.layer(views.raster(spark, folder), "primary"), target)
    return tables.read_images(spark, target, ["1", "4"]).select("image", "y", "x", "label")


@query(
    "label_rasters_all_round_trip",
    f"WITH {views.RASTER_SQL} SELECT image, y, x, primary_label AS label FROM v_raster WHERE primary_label >= 0",
)
def label_rasters_all_round_trip(spark, folder):
    """All images are stored, and all are read."""
    target, layer = work_folder(spark, "label-rasters"), views.layer(views.raster(spark, folder), "primary")
    tables.write_label_rasters(layer, target)
    return tables.read_all_images(spark, target).select("image", "y", "x", "label")


@query(
    "class_masks_round_trip",
    f"WITH {views.RASTER_SQL} SELECT image, y, x, primary_label AS class_id FROM v_raster WHERE primary_label >= 0",
)
def class_masks_round_trip(spark, folder):
    target = work_folder(spark, "class-masks")
    layer = views.layer(views.raster(spark, folder), "primary")
    tables.write_class_masks(layer.withColumnRenamed("label", "class_id"), target)
    return spark.read.parquet(target).select("image", "y", "x", F.col("class_id").cast("int"))


@query(
    "prediction_cache_round_trip",
    f"""WITH {views.RASTER_SQL} SELECT 'a' AS method, image, y, x, pred_label AS label FROM v_raster WHERE pred_label >= 0
    UNION ALL SELECT 'b', image, y, x, secondary_label FROM v_raster WHERE secondary_label >= 0""",
)
def prediction_cache_round_trip(spark, folder):
    target, raster = work_folder(spark, "prediction-cache"), views.raster(spark, folder)
    both = [views.layer(raster, n).withColumn("method", F.lit(m)) for m, n in (("a", "pred"), ("b", "secondary"))]
    tables.write_prediction_cache(both[0].unionByName(both[1]), target)
    return rasters.read_prediction_cache(spark, target).select("method", "image", "y", "x", "label")


# --- reports ----------------------------------------------------------------------


def _predictions(raster: DataFrame) -> DataFrame:
    label = F.when(F.col("pred_label") >= 0, F.col("pred_label"))
    return raster.select(
        "image", "y", "x", label.isin(*views.POSITIVE_IDS).cast("int").alias("pred_binary"), label.alias("pred_class")
    ).filter("pred_class IS NOT NULL")


REPORT_SQL = views.FUSED_SQL + """,
k AS (SELECT image, gt AS class_id FROM scored GROUP BY ALL),
c AS (SELECT k.image, k.class_id, count(*) FILTER (WHERE gt = class_id AND pred = class_id) AS tp,
        count(*) FILTER (WHERE gt <> class_id AND pred = class_id) AS fp, count(*) FILTER (WHERE gt = class_id AND pred IS DISTINCT FROM class_id) AS fn
      FROM k JOIN scored USING (image) GROUP BY ALL)"""


@query(
    "per_image_report_file",
    f"WITH {REPORT_SQL} SELECT 'model' AS method, CAST(image AS BIGINT) AS image, CAST(class_id AS BIGINT) AS class_id, tp, fp, fn FROM c",
)
def per_image_report_file(spark, folder):
    """Scores of a whole evaluation, stored as JSON with the other reports and read back."""
    raster, target = views.raster(spark, folder), work_folder(spark, "reports")
    names = {c: f"class {c}" for c in views.CLASS_IDS}
    done = evaluate(
        views.layer(raster, "primary"),
        views.layer(raster, "secondary"),
        views.raster_dims(raster),
        {"model": _predictions(raster)},
        EvaluationConfig(names),
    ).stored()
    report = tables.nested_report(done.report_overall, done.report_class, done.report_binary)
    tables.write_reports(report, done.image_class, target)
    return spark.read.json(f"{target}/per_image").select("method", "image", "class_id", "tp", "fp", "fn")


@query(
    "evaluate_resized",
    f"WITH {REPORT_SQL} SELECT image, class_id, tp, fp, fn FROM c",
)
def evaluate_resized(spark, folder):
    """A prediction of twice the size, each label repeated, is brought to the truth's size by the run."""
    raster = views.raster(spark, folder)
    dims = views.raster_dims(raster)
    twice = _predictions(raster)
    for axis in ("y", "x"):
        twice = twice.withColumn(axis, F.explode(F.array(F.col(axis) * 2, F.col(axis) * 2 + 1)))
    double = dims.select("image", (F.col("height") * 2).alias("height"), (F.col("width") * 2).alias("width"))

    class Stored:
        name, dims = "model", double

        def required_inputs(self, images):
            return None

        def predict(self):
            return twice

    config = RunConfig(EvaluationConfig({c: str(c) for c in views.CLASS_IDS}))
    done = run_evaluation(
        views.layer(raster, "primary"), views.layer(raster, "secondary"), dims, [Stored()], config, secondary_dims=dims
    )
    return done.image_class.select("image", "class_id", "tp", "fp", "fn")


@query(
    "summary_file",
    """SELECT concat('m', CAST(n_nationkey AS STRING)) AS method, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey * 1e0 ELSE n_nationkey / 4e0 END AS mean_iou FROM nation""",
)
def summary_file(spark, folder):
    """A second summary replaces its methods in the first and keeps the others, through files."""
    nation, target = table(spark, folder, "nation"), work_folder(spark, "summary")
    name = F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("method")
    first = nation.select(name, (F.col("n_nationkey") / F.lit(4.0)).alias("mean_iou"))
    second = nation.filter("n_nationkey % 2 = 0").select(name, (F.col("n_regionkey") * F.lit(1.0)).alias("mean_iou"))
    tables.upsert_summary(first, f"{target}/1", f"{target}/0")
    tables.upsert_summary(second, f"{target}/2", f"{target}/1")
    return spark.read.schema(first.schema).json(f"{target}/2")


@query(
    "camera_list_file",
    f"WITH {views.CAMERAS_SQL} SELECT CAST(camera_id AS BIGINT) AS image, fx, t0 FROM v_cameras",
)
def camera_list_file(spark, folder):
    target = work_folder(spark, "camera-list")
    tables.write_camera_list(views.cameras(spark, folder), target)
    return spark.read.json(target).select("image", "fx", "t0")


# --- configuration and scenes -----------------------------------------------------


@query(
    "int_map_file",
    "SELECT CAST(n_nationkey AS INT) AS key, CAST(n_regionkey AS INT) AS value FROM nation",
)
def int_map_file(spark, folder):
    path = _object(table(spark, folder, "nation"), "n_nationkey", F.col("n_regionkey"), work_folder(spark, "int-map"))
    return configs.read_int_map(spark, path)


@query("class_prompts_file", "SELECT CAST(p_partkey AS INT) AS class_id, p_name AS name, 2 AS n FROM part")
def class_prompts_file(spark, folder):
    """Every part as a class with two prompts."""
    part = table(spark, folder, "part")
    path = _entries(part, "p_partkey", F.array("p_name", "p_brand"), work_folder(spark, "prompts"))
    back = configs.read_class_prompts(spark, path, lines=True)
    return back.select("class_id", F.col("prompts")[0].alias("name"), F.size("prompts").alias("n"))


@query(
    "entities_file",
    f"WITH {views.ENTITIES_SQL} SELECT entity_id, type, parent_id FROM v_entities",
)
def entities_file(spark, folder):
    value = F.struct("type", F.col("parent_id").alias("parent"))
    path = _entries(views.entities(spark, folder), "entity_id", value, work_folder(spark, "entities"))
    return configs.read_entities(spark, path, lines=True)


@query(
    "scene_text",
    """SELECT concat('c', CAST(s_suppkey AS STRING), '.png') AS image, 640 AS width, 480 AS height, 500e0 + s_nationkey AS fx, 510e0 AS fy, 1e0 AS r00,
    s_suppkey / 4e0 AS t0, -2e0 AS t1, 5e-1 AS t2 FROM supplier""",
)
def scene_text(spark, folder):
    """Suppliers as posed pictures, nations as cameras, in the two text files of a scene."""
    target = work_folder(spark, "scene")
    nation, supplier = table(spark, folder, "nation"), table(spark, folder, "supplier")
    fx = (F.col("n_nationkey") + 500).cast("string")
    _lines(
        nation.select(F.concat_ws(" ", F.col("n_nationkey").cast("string"), F.lit("PINHOLE 640 480"), fx, F.lit("510 320 240"))),
        f"{target}/cameras.txt",
    )
    pose = F.concat_ws(
        " ",
        F.col("s_suppkey").cast("string"),
        F.lit("1 0 0 0"),
        (F.col("s_suppkey") / F.lit(4.0)).cast("string"),
        F.lit("-2 0.5"),
        F.col("s_nationkey").cast("string"),
        F.concat(F.lit("c"), F.col("s_suppkey").cast("string"), F.lit(".png")),
    )
    _lines(supplier.select(F.concat(pose, F.lit("\n1.5 2.5 7"))), f"{target}/images.txt")
    # Spark stores each file as a folder, so both are given their scene here
    seen = scenes.read_poses_text(spark, f"{target}/images.txt").withColumn("scene", F.lit("s"))
    lenses = scenes.read_intrinsics_text(spark, f"{target}/cameras.txt").withColumn("scene", F.lit("s"))
    cameras = camera.resolve_cameras(seen, lenses)
    return cameras.select("image", "width", "height", "fx", "fy", "r00", "t0", "t1", "t2")


@query(
    "scene_points_text",
    """SELECT p_partkey AS id, p_partkey / 4e0 AS x, p_size * 1e0 AS y, 25e-2 AS z, CAST(p_partkey % 256 AS INT) AS r, 1 AS g, 2 AS b, 5e-1 AS error FROM part""",
)
def scene_points_text(spark, folder):
    part = table(spark, folder, "part")
    key = F.col("p_partkey")
    line = F.concat_ws(
        " ", key.cast("string"), (key / F.lit(4.0)).cast("string"), F.col("p_size").cast("string"), F.lit("0.25"), (key % 256).cast("string"), F.lit("1 2 0.5 3 4 5 6")
    )
    path = _lines(part.select(line), f"{work_folder(spark, 'scene-points')}/points3D.txt")
    return scenes.read_points3d_text(spark, path).select("id", "x", "y", "z", "r", "g", "b", "error")


def _binary_scenes(df: DataFrame, target: str, name: str, record) -> None:
    """One scene folder a partition, with all its rows as records behind their number."""

    def write(batches):
        rows, scene = [], None
        for batch in batches:
            for row in batch.to_pylist():
                scene = row["_scene"] if scene is None else scene
                rows.append(record(row))
        if rows:
            fs, inner = records.open_filesystem(f"{target}/scene{scene}")
            fs.create_dir(inner, recursive=True)
            with fs.open_output_stream(f"{inner}/{name}") as out:
                out.write(struct.pack("<Q", len(rows)) + b"".join(rows))
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(rows)], pa.int64())})

    df.repartition(4).withColumn("_scene", F.spark_partition_id()).mapInArrow(write, "n long").agg(F.sum("n")).first()


@query(
    "scene_binary",
    """SELECT concat('c', CAST(s_suppkey AS STRING), '.png') AS image, 320 AS width, 120 AS height, round((500e0 + s_nationkey) / 2, 6) AS fx, 127.5e0 AS fy,
    1e0 AS r00, s_suppkey / 4e0 AS t0, -2e0 AS t1, 5e-1 AS t2 FROM supplier""",
)
def scene_binary(spark, folder):
    """Suppliers as posed pictures, nations as cameras, in the binary files of four scenes, resolved for half the size."""
    target = work_folder(spark, "scene-binary")
    scene = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("_scene")
    lenses = table(spark, folder, "nation").select("n_nationkey", scene)

    def camera_record(row):
        return struct.pack("<iiQQ4d", row["n_nationkey"], 1, 640, 480, 500.0 + row["n_nationkey"], 510.0, 320.0, 240.0)

    def write(_, part):
        body = b"".join(camera_record(r) for r in part.sort_by("n_nationkey").to_pylist())
        fs, inner = records.open_filesystem(f"{target}/scene{part.column('_scene')[0].as_py()}")
        fs.create_dir(inner, recursive=True)
        with fs.open_output_stream(f"{inner}/cameras.bin") as out:
            out.write(struct.pack("<Q", part.num_rows) + body)
        return pa.table({"n": pa.array([part.num_rows], pa.int64())})

    lenses.groupBy("_scene").applyInArrow(write, "n long").agg(F.sum("n")).first()

    def image_record(row):
        key = row["s_suppkey"]
        pose = struct.pack("<i7di", key, 1.0, 0.0, 0.0, 0.0, key / 4.0, -2.0, 0.5, row["s_nationkey"])
        seen = struct.pack("<ddq", 1.5, 2.5, 7) * (key % 3)
        return pose + f"c{key}.png".encode() + b"\0" + struct.pack("<Q", key % 3) + seen

    _binary_scenes(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), target, "images.bin", image_record)
    cameras = scenes.load_cameras(spark, f"{target}/scene*", 320, 120)
    return rounded(cameras.select("image", "width", "height", "fx", "fy", "r00", "t0", "t1", "t2"), "fx")


@query(
    "scene_points_binary",
    """SELECT p_partkey AS id, p_partkey / 4e0 AS x, p_size * 1e0 AS y, 25e-2 AS z, CAST(p_partkey % 256 AS INT) AS r, 1 AS g, 2 AS b, 5e-1 AS error FROM part""",
)
def scene_points_binary(spark, folder):
    """Parts as points with tracks of different lengths; each file is read in ranges of 500 points."""
    target = work_folder(spark, "points-binary")

    def point_record(row):
        key = row["p_partkey"]
        track = struct.pack("<ii", key % 7, 1) * (key % 5)
        return struct.pack("<Q3d3BdQ", key, key / 4.0, float(row["p_size"]), 0.25, key % 256, 1, 2, 0.5, key % 5) + track

    _binary_scenes(table(spark, folder, "part").select("p_partkey", "p_size"), target, "points3D.bin", point_record)
    back = scenes.read_points3d_binary(spark, f"{target}/scene*/points3D.bin", every=500)
    return back.select("id", "x", "y", "z", "r", "g", "b", "error")


@query(
    "transform_cameras_file",
    """SELECT concat('v', CAST(s_suppkey AS STRING)) AS image, 800 AS width, -(s_suppkey * 1e0) AS t0, 2e0 AS t1, 3e0 AS t2, 1e0 AS r00, -1e0 AS r11 FROM supplier""",
)
def transform_cameras_file(spark, folder):
    """Pose lines with a frame per supplier, axis-aligned, at x = key, y = 2, z = 3."""
    key = F.col("s_suppkey")

    def row(*values):
        return F.array(*[v if not isinstance(v, (int, float)) else F.lit(float(v)) for v in values])

    matrix = F.array(row(1, 0, 0, key * F.lit(1.0)), row(0, 1, 0, 2), row(0, 0, 1, 3), row(0, 0, 0, 1))
    frame = F.struct(F.concat(F.lit("r/v"), key.cast("string")).alias("file_path"), matrix.alias("transform_matrix"))
    poses = table(spark, folder, "supplier").select(F.lit(0.5).alias("camera_angle_x"), F.array(frame).alias("frames"))
    path = _lines(poses.select(F.to_json(F.struct("camera_angle_x", "frames"))), work_folder(spark, "transforms"))
    back = scenes.read_transform_cameras(spark, path, 800, 600, lines=True)
    return back.select("image", "width", *[r6(n).alias(n) for n in ("t0", "t1", "t2", "r00", "r11")])


# --- arrays, pictures and LAS files -----------------------------------------------


@query(
    "npy_round_trip",
    f"WITH {views.RASTER_SQL} SELECT image, y, x, primary_label AS label FROM v_raster WHERE primary_label >= 0",
)
def npy_round_trip(spark, folder):
    """Label rasters as array files in blocks of 64 rows, read line by line."""
    raster, target = views.raster(spark, folder), work_folder(spark, "npy-labels")
    records.register(spark)
    npy.write_rasters(views.layer(raster, "primary"), views.raster_dims(raster), target, block_rows=64)
    return rasters.read_label_rasters(spark, target).withColumn("image", F.col("image").cast("int"))


@query(
    "npy_features_round_trip",
    f"""WITH {views.RASTER_SQL}, dims AS (SELECT image, max(y) + 1 AS height FROM v_raster GROUP BY image),
    one AS (SELECT arg_min(height, image) AS height FROM dims)
    SELECT image, y, x, primary_label * 1e0 AS first, (y % 7) / 4e0 AS second, one.height, 20 AS width FROM v_raster, one""",
)
def npy_features_round_trip(spark, folder):
    """A vector per pixel as (height, width, channels) arrays, with the size of the first file."""
    raster, target = views.raster(spark, folder), work_folder(spark, "npy-features")
    records.register(spark)
    vector = F.array(F.col("primary_label").cast("float"), ((F.col("y") % 7) / F.lit(4.0)).cast("float"))
    pixels = raster.select("image", "y", "x", vector.alias("feature"))
    npy.write_rasters(pixels, views.raster_dims(raster), target, "feature", empty=-99.0, channels=2, block_rows=1 << 20)
    size = rasters.detect_resolution(spark, target).select(F.struct("height", "width")).scalar()
    back = rasters.read_feature_rasters(spark, target).filter(F.col("feature")[0] != -99.0)
    return back.withColumn("_size", size).select(
        F.col("image").cast("int").alias("image"),
        "y",
        "x",
        *[F.col("feature")[i].cast("double").alias(n) for i, n in enumerate(("first", "second"))],
        "_size.height",
        "_size.width",
    )


def _png(ids: np.ndarray) -> bytes:
    """A grey picture of eight bits."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = ids.shape
    lines = np.zeros((height, width + 1), np.uint8)
    lines[:, 1:] = ids
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def _pictures(df: DataFrame, target: str) -> None:
    """image, height, width, y, x, id as one picture per image, stored by tasks."""
    fs, inner = records.open_filesystem(target)
    fs.create_dir(inner, recursive=True)

    def write(_, part):
        ids = np.zeros((part.column("height")[0].as_py(), part.column("width")[0].as_py()), np.uint8)
        ids[part.column("y").to_numpy(), part.column("x").to_numpy()] = part.column("id").to_numpy()
        fs, inner = records.open_filesystem(target)
        with fs.open_output_stream(f"{inner}/{part.column('image')[0].as_py()}.png") as out:
            out.write(_png(ids))
        return pa.table({"n": pa.array([part.num_rows], pa.int64())})

    df.groupBy("image").applyInArrow(write, "n long").agg(F.sum("n")).first()


@query(
    "instance_pictures_round_trip",
    f"WITH {views.RASTER_SQL} SELECT image, y, x, primary_label + 1 AS instance_id FROM v_raster WHERE primary_label >= 0",
)
def instance_pictures_round_trip(spark, folder):
    """Labels as ids in 8-bit pictures; 0 is no instance."""
    raster, target = views.raster(spark, folder), work_folder(spark, "pictures")
    ids = raster.join(F.broadcast(views.raster_dims(raster)), "image")
    _pictures(ids.select("image", "height", "width", "y", "x", (F.col("primary_label") + 1).alias("id")), target)
    back = rasters.read_instance_rasters(spark, target).filter("instance_id > 0")
    return back.withColumn("image", F.col("image").cast("int"))


@query(
    "las_round_trip",
    f"""WITH {views.POINTS_SQL} SELECT point_idx AS id, round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z, class FROM v_points""",
)
def las_round_trip(spark, folder):
    """Clouds as LAS files of hundredths, a file per task, read back and met again by file and record number."""
    cloud, target = views.points(spark, folder), work_folder(spark, "las")
    fs, inner = records.open_filesystem(target)
    fs.create_dir(inner, recursive=True)

    def write(batches):
        from pyspark import TaskContext

        record = np.dtype([("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("rest", "V3"), ("class", "u1"), ("more", "V4")])
        parts = []
        for batch in batches:
            block = np.zeros(batch.num_rows, record)
            for a in "xyz":
                block[a.upper()] = np.rint(batch.column(a).to_numpy() * 100)
            block["class"] = batch.column("class").to_numpy()
            parts.append(block)
        points_ = np.concatenate(parts) if parts else np.zeros(0, record)
        head = bytearray(227)
        head[:4], head[24:26] = b"LASF", bytes([1, 2])
        struct.pack_into("<HII", head, 94, 227, 227, 0)
        head[104] = 0
        struct.pack_into("<HI", head, 105, record.itemsize, len(points_))
        struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 0.0, 0.0, 0.0)
        fs, inner = records.open_filesystem(target)
        with fs.open_output_stream(f"{inner}/tile-{TaskContext.get().partitionId():04d}.las") as out:
            out.write(bytes(head) + points_.tobytes())
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(points_)], pa.int64())})

    # numbered by file and record on both sides: the order of a task's rows is the file's order
    laid = cloud.repartition(4, "point_idx").sortWithinPartitions("point_idx")
    laid.select("x", "y", "z", F.col("class").cast("int")).mapInArrow(write, "n long").agg(F.sum("n")).first()
    back = points.read_points(spark, target, "las")
    names = laid.withColumn("_file", F.format_string("tile-%04d.las", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_file").orderBy("point_idx")) - 1
    names = names.select(F.col("point_idx").alias("id"), "_file", inside.cast("long").alias("_at"))
    met = back.join(names, (back["src_file"] == names["_file"]) & (back["point_idx"] == names["_at"]))
    return met.select("id", *[F.round(a, 2).alias(a) for a in "xyz"], "class")


@query(
    "ordered_report_file",
    """SELECT c_name AS name, c_acctbal AS score, row_number() OVER (ORDER BY c_name) - 1 AS position FROM customer""",
)
def ordered_report_file(spark, folder):
    """Rows stored in name order by several tasks, and the place at which each is read back."""
    target = work_folder(spark, "ordered")
    rows = table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"))
    ordered.write_ordered(rows.repartition(7), target, ["name"], files=7)
    return ordered.read_ordered(spark, target, "name string, score double")


@query(
    "ordered_table_file",
    """SELECT o_orderkey AS id, o_orderpriority AS priority, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS position FROM orders""",
)
def ordered_table_file(spark, folder):
    """The same through Parquet, by a column with few values: ties come in the order of the other columns."""
    target = work_folder(spark, "ordered")
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    ordered.write_ordered(rows, target, ["priority"], "parquet")
    return ordered.read_ordered(spark, target, "id long, priority string", "parquet")


# --- steering files and reports ---------------------------------------------------


@query("retention_file", "SELECT n_nationkey AS class_id, (n_regionkey + 1) / 8e0 AS rate FROM nation")
def retention_file(spark, folder):
    """Rates per class, next to a note that is no class."""
    target = work_folder(spark, "retention")
    nation = table(spark, folder, "nation")
    entries = F.collect_list(F.struct(F.col("n_nationkey").cast("string"), ((F.col("n_regionkey") + 1) / F.lit(8.0)).cast("string")))
    note = F.create_map(F.lit("_note"), F.lit("rates by class"))
    _lines(nation.agg(F.to_json(F.map_concat(F.map_from_entries(entries), note)).alias("value")), target)
    rates = configs.read_retention(spark, target)
    return spark.createDataFrame(sorted(rates.items()), "class_id long, rate double")


@query(
    "frame_shift_file",
    f"""WITH {views.POINTS_SQL}, s AS (SELECT sum(r_regionkey) / 4e0 AS a, -count(*) * 1e0 AS b, 5e-1 AS c FROM region)
    SELECT src_file, point_idx, round(x + a, 6) AS x, round(y + b, 6) AS y, round(z + c, 6) AS z FROM v_points, s""",
)
def frame_shift_file(spark, folder):
    target = work_folder(spark, "frame")
    shift = F.array(F.sum("r_regionkey") / F.lit(4.0), -F.count("*") * F.lit(1.0), F.lit(0.5))
    doc = F.struct(F.struct(shift.alias("shift"), F.lit(2.0).alias("scale")).alias("base_to_canonical"))
    _lines(table(spark, folder, "region").agg(F.to_json(doc).alias("value")), target)
    moved = frame_shift(views.points(spark, folder), configs.read_frame_shift(spark, target))
    return rounded(moved, "x", "y", "z").select("src_file", "point_idx", "x", "y", "z")


@query(
    "projection_stats_file",
    f"""WITH {views.RASTER_SQL}, seen AS (SELECT * FROM v_raster WHERE primary_label >= 0),
    d AS (SELECT image, (max(y) + 1) * 20e0 AS size FROM v_raster GROUP BY image),
    n AS (SELECT image, count(*) FILTER (WHERE diagonal % 7 <> 0) AS before, count(*) AS after FROM (SELECT seen.*, y + x AS diagonal FROM seen) GROUP BY image)
    SELECT image, round(coalesce(before, 0) / size, 6) AS coverage_before, round(coalesce(after, 0) / size, 6) AS coverage_after
    FROM d LEFT JOIN n USING (image)""",
)
def projection_stats_file(spark, folder):
    """Coverage before and after filling, stored as JSON and read back."""
    raster, target = views.raster(spark, folder), work_folder(spark, "stats")
    filled = views.layer(raster, "primary").withColumn("filled", (F.col("y") + F.col("x")) % 7 == 0)
    per_image, _ = projection.projection_stats(filled, views.raster_dims(raster))
    tables.write_projection_stats(per_image, target)
    back = spark.read.json(target).withColumn("image", F.col("image").cast("int"))
    return rounded(back.select("image", "coverage_before", "coverage_after"), "coverage_before", "coverage_after")


@query(
    "instance_features_file",
    "SELECT vec_id AS instance_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, len(embedding) AS n FROM embeddings",
)
def instance_features_file(spark, folder):
    """Vectors as matrices of 500 rows with their ids, in archives that tasks store."""
    target = work_folder(spark, "archives")
    fs, inner = records.open_filesystem(target)
    fs.create_dir(inner, recursive=True)

    def write(key, part):
        fs, inner = records.open_filesystem(target)
        matrix = np.stack(part.column("embedding").to_pylist()).astype(np.float32)
        with fs.open_output_stream(f"{inner}/part-{key[0].as_py()}.npz") as out:
            np.savez(out, features=matrix, ids=part.column("vec_id").to_numpy())
        return pa.table({"n": pa.array([part.num_rows], pa.int64())})

    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", F.expr("vec_id div 500").alias("part"))
    rows.groupBy("part").applyInArrow(write, "n long").agg(F.sum("n")).first()
    back = rasters.read_instance_features(spark, target)
    first = F.round(F.col("feature")[0].cast("double"), 6)
    return back.select(F.col("instance_id").cast("long"), first.alias("first"), F.size("feature").cast("long").alias("n"))


@query(
    "stability_file",
    f"""WITH {CLASS_COUNTS_SQL},
    o AS (SELECT avg(m) AS overall FROM (SELECT image, avg(iou) AS m FROM class_scores GROUP BY image))
    SELECT 'model' AS method, class_id, round(max(overall), 6) AS overall_mean_iou, round(avg(iou), 6) AS iou, CAST(sum(tp) AS BIGINT) AS tp,
      CAST(sum(fn) AS BIGINT) AS fn FROM class_scores, o WHERE class_id IN (1, 101, 103) GROUP BY class_id""",
)
def stability_file(spark, folder):
    """Chosen classes of a method as nested JSON, read back by class."""
    target = work_folder(spark, "stability")
    scores = _class_scores(spark, folder).withColumn("method", F.lit("model"))
    overall = metrics.report_overall(metrics.image_summary(scores, by=("method", "image")), by=("method",))
    tables.write_stability(metrics.stability_subset(metrics.report_class(scores), overall, [1, 101, 103]), target)
    each = "struct<precision: double, recall: double, iou: double, counts: struct<tp: long, fp: long, fn: long, tn: long>>"
    back = spark.read.schema(f"method string, overall_mean_iou double, target_classes map<string, {each}>").json(target)
    back = back.select("method", "overall_mean_iou", F.explode("target_classes").alias("class_id", "s"))
    return back.select(
        "method",
        F.col("class_id").cast("int").alias("class_id"),
        r6("overall_mean_iou").alias("overall_mean_iou"),
        r6("s.iou").alias("iou"),
        F.col("s.counts.tp").alias("tp"),
        F.col("s.counts.fn").alias("fn"),
    )
