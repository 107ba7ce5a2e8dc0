"""Inputs come back whole: no reader or operator drops, caps or changes data silently."""

import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from rasterloom.operators import camera, hierarchy, instances, knn, sampling, tiles
from rasterloom.plans.evaluate import EvaluationConfig, compare_methods
from rasterloom.plans.run import RunConfig, run_evaluation, store
from rasterloom.sinks import tables
from rasterloom.sources import configs, points, rasters, records
from tests.test_sources import las_file


def png(path, array, depth=8):
    height, width = array.shape
    raw = b"".join(b"\0" + row.tobytes() for row in array)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, depth, 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_wide_ids_are_refused(spark, tmp_path):
    png(tmp_path / "a.png", np.array([[300, 513]], dtype=">u2"), 16)
    with pytest.raises(Exception, match="8-bit picture.*a.png has 16 bits"):
        rasters.read_instance_rasters(spark, str(tmp_path)).collect()


def test_broken_picture_is_named(spark, tmp_path):
    png(tmp_path / "a.png", np.array([[1]], dtype=np.uint8))
    (tmp_path / "b.png").write_bytes(b"not a picture")
    (tmp_path / "notes.txt").write_bytes(b"not a picture either")
    with pytest.raises(Exception, match="cannot decode picture .*b.png"):
        rasters.read_pictures(spark, str(tmp_path)).collect()


def test_large_maps(spark, tmp_path):
    n = 70_000
    (tmp_path / "rates.json").write_text(json.dumps({str(i): i / n for i in range(n)}))
    (tmp_path / "merge.json").write_text(json.dumps({str(i): [i + 1] for i in range(n)}))
    (tmp_path / "colors.json").write_text(json.dumps({str(i): [1, 2, 3] for i in range(n)}))
    assert len(configs.read_retention(spark, str(tmp_path / "rates.json"))) == n
    assert list(configs.read_merge_map(spark, str(tmp_path / "merge.json"))) == list(range(n))
    assert len(configs.read_colors(spark, str(tmp_path / "colors.json"))) == n
    assert configs.read_merge_map(spark, str(tmp_path / "absent.json")) == {}


@pytest.mark.parametrize("block", [4096, 7])
def test_any_number_of_prototypes(spark, monkeypatch, block):
    monkeypatch.setattr(instances, "PROTOTYPE_BLOCK", block)
    rng = np.random.default_rng(1)
    classes = rng.normal(size=(50, 6))
    classes /= np.linalg.norm(classes, axis=1, keepdims=True)
    classes[40] = classes[3]  # a tie
    rows = rng.normal(size=(30, 6))
    rows[0] = classes[3] * 2
    got = instances.classify_instances(
        spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "instance_id int, feature array<double>"),
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(classes)], "class_id int, feature array<double>"),
        0.8,
    )
    got = {r.instance_id: (r.label, r.score) for r in got.collect()}
    scores = (rows / np.linalg.norm(rows, axis=1, keepdims=True)) @ classes.T
    for i, row in enumerate(scores):
        assert got[i][1] == pytest.approx(row.max())
        assert got[i][0] == (int(row.argmax()) if row.max() >= 0.8 else None)
    assert got[0][0] == 3


def test_dense_spot(spark):
    """Places far closer together than the first cell still get the smallest cells they need."""
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, r)) for r in rng.random((200, 3)) * 1e-9] + [(5.0, 5.0, 5.0)]
    cloud = spark.createDataFrame(rows, "x double, y double, z double")
    edges = {(r.x, r.y, r.z): r._edge for r in knn.with_edges(cloud, 1.0, 16).collect()}
    assert len(edges) == 201 and edges[5.0, 5.0, 5.0] == 1.0
    cells = {}
    for r in rows[:200]:
        key = (edges[r], *(int(v // edges[r]) for v in r))
        cells[key] = cells.get(key, 0) + 1
    assert max(cells.values()) <= 16 and max(edges[r] for r in rows[:200]) < 1e-9


def test_a_dense_spot_changes_no_rounds_elsewhere(spark, monkeypatch):
    """100,000 points in one spot: places elsewhere are settled in the rounds they took without it."""
    rng = np.random.default_rng(7)
    plain = rng.random((3000, 3)) * 40
    spot = rng.random((100_000, 3)) * 1e-3 + 55.0
    rounds = []
    search = knn._search

    def counted(open_places, *rest):
        rounds[-1].append({(r.x, r.y, r.z) for r in open_places.filter("x < 41").select("x", "y", "z").collect()})
        return search(open_places, *rest)

    monkeypatch.setattr(knn, "_search", counted)
    results = []
    for cloud in (plain, np.concatenate([plain, spot])):
        rounds.append([])
        frame = spark.createDataFrame(pd.DataFrame(cloud, columns=["x", "y", "z"]))
        out = knn.initial_scale(frame, 2.0).filter("x < 41").collect()
        results.append({(r.x, r.y, r.z): r.mean_sq for r in out})
    assert results[0] == pytest.approx(results[1]) and len(results[0]) == 3000
    first, second = ([r for r in some if r] for some in rounds)
    assert first == second


def test_files_of_one_name(spark, tmp_path):
    for folder in "ab":
        (tmp_path / folder).mkdir()
        las_file(tmp_path / folder / "t.las", [(i, i, 0) for i in range(1000)], [1] * 1000)
    cloud = points.read_points(spark, str(tmp_path), "las")
    assert {r.src_file for r in cloud.select("src_file").distinct().collect()} == {"a/t.las", "b/t.las"}
    assert cloud.select("src_file", "point_idx").distinct().count() == 2000
    assert points.count_points(spark, str(tmp_path), "las") == 2000
    assert sampling.uniform_sample(cloud, 0.2005, seed=3).count() == 401


class Fixed:
    def __init__(self, name, pixels, dims=None):
        self.name, self._pixels, self.dims = name, pixels, dims

    def required_inputs(self, images):
        raise NotImplementedError

    def predict(self):
        return self._pixels


def test_run_resizes_and_checks_sizes(spark, tmp_path):
    def layer(size, label, name="label"):
        return spark.createDataFrame([("a", y, x, label) for y in range(size) for x in range(size)], f"image string, y int, x int, {name} int")

    def dims(size):
        return spark.createDataFrame([("a", size, size)], "image string, height int, width int")

    def method(size):
        return layer(size, 1, "pred_class").selectExpr("image", "y", "x", "1 AS pred_binary", "pred_class")

    config = RunConfig(EvaluationConfig({1: "wall", 2: "roof"}))
    both = layer(8, 1), layer(8, 2)
    with pytest.raises(ValueError, match="a: 8x8 and 4x4"):
        run_evaluation(*both, dims(8), [], config, secondary_dims=dims(4))
    done = run_evaluation(*both, dims(8), [Fixed("half", method(4), dims(4)), Fixed("full", method(8))], config, secondary_dims=dims(8))
    scores = {(r.method, r.class_id): r.iou for r in done.image_class.collect()}
    assert scores["half", 1] == scores["full", 1] == pytest.approx(1.0)
    store(done, str(tmp_path / "out"), config)
    assert spark.read.json(str(tmp_path / "out" / "report")).count() == 2
    cache = rasters.read_prediction_cache(spark, str(tmp_path / "out" / "predictions"))
    assert cache.count() == 2 * 64
    other = spark.createDataFrame([("b",)], "image string")
    assert compare_methods(cache, also=[other]).count() == 0


def test_broken_summary_line(spark, tmp_path):
    folder = tmp_path / "old"
    folder.mkdir()
    (folder / "part.json").write_text('{"method":"a","mean_iou":0.5}\n{"method":"b","mean_io\nnot json\n')
    new = spark.createDataFrame([("c", 0.25)], "method string, mean_iou double")
    tables.upsert_summary(new, str(tmp_path / "new"), str(folder))
    assert sorted(map(tuple, spark.read.schema(new.schema).json(str(tmp_path / "new")).collect())) == [("a", 0.5), ("c", 0.25)]


def test_far_point_adds_no_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [("f", i, *map(float, p), 1) for i, p in enumerate(rng.uniform(-10, 10, (1500, 3)))]
    turn = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    cams = [(f"c{i}", 64, 48, 60.0, 60.0, 32.0, 24.0, *turn, float(i - 4), 0.0, 12.0) for i in range(8)]
    cameras = spark.createDataFrame(
        cams, "image string, width int, height int, " + ", ".join(f"{n} double" for n in camera.CAMERA_COLUMNS[3:])
    )

    def pairs(points):
        cloud = spark.createDataFrame(points, "src_file string, point_idx long, x double, y double, z double, class int")
        edge = camera.cell_edge(cloud)
        cells = cloud.select(*[F.floor(F.col(a) / edge).cast("double").alias(f"_c{a}") for a in "xyz"]).distinct()
        return edge, camera.visible_cells(cells, cameras, edge, 0.01, 50.0).count(), cells.count()

    plain = pairs(rows)
    assert plain[1] < 0.7 * plain[2] * len(cams)
    assert pairs([*rows, ("f", 9999, 1e7, -1e7, 1e6, 1)])[:2] == plain[:2]


@pytest.mark.parametrize("width", [1, 150, 849])
def test_halo_copies_are_bounded(spark, width):
    pixels = spark.range(4000).select(F.lit("a").alias("image"), (F.col("id") * 7).cast("int").alias("y"), (F.col("id") * 13 % 30_000).cast("int").alias("x"), F.lit(width).alias("_d"))
    copies = tiles.to_tiles(pixels, F.col("_d"), tiles.tile_for(F.col("_d"))).groupBy("y", "x").count()
    assert copies.agg(F.max("count")).first()[0] <= 4


def test_arrays_are_split(spark, tmp_path):
    """Lines of one array come from several tasks, whatever the byte borders, and sizes from headers."""
    rng = np.random.default_rng(6)
    labels = rng.integers(-1, 9, (57, 31)).astype(np.int16)
    np.save(tmp_path / "a.npy", labels)
    records.register(spark)
    lines = spark.read.format("npy").option("splitbytes", "500").load(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 5 and lines.count() == 57
    got = {(r.y, r.x): r.label for r in rasters.read_label_rasters(spark, str(tmp_path)).collect()}
    assert got == {(y, x): int(labels[y, x]) for y, x in zip(*np.nonzero(labels >= 0))}
    dims = rasters.read_raster_dims(spark, str(tmp_path)).first()
    assert (dims.image, dims.height, dims.width, dims.axes) == ("a", 57, 31, 2)
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 4))))
    with pytest.raises(Exception, match="row by row"):
        rasters.read_label_rasters(spark, str(tmp_path)).collect()


def test_many_children_of_one_root(spark):
    rows = spark.range(100_000).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("entity_id"), F.lit("Part").alias("type"), F.lit("r").alias("parent_id")
    )
    root = spark.createDataFrame([("r", "WallSurface", None)], "entity_id string, type string, parent_id string")
    got = hierarchy.reached_types(rows.unionByName(root), ["WallSurface"])
    assert got.count() == 100_001 and got.filter("types = array('WallSurface')").count() == 100_001


def test_windows_have_their_full_size(spark):
    seen = spark.createDataFrame([("a", 0, 0, 1), ("a", 1, 1, 2)], "image string, y int, x int, r int")
    dims = spark.createDataFrame([("a", 5, 7)], "image string, height int, width int")

    def shape(block):
        out = np.zeros((*block.shape[:2], 2), np.float32)
        out[..., 0], out[..., 1] = block.shape[:2]
        return out

    got = tiles.predict_windows(seen, dims, shape, ["r"], window=6, stride=4).collect()
    assert {tuple(r.scores) for r in got if r.y == 0} == {(5.0, 6.0)}


def test_colored_cloud_of_any_key(spark, tmp_path):
    """Orders beyond what single precision counts to come back with their keys."""
    from workloads.io_queries import ply_colored_round_trip

    keys = [1, 1048575, 1048576, 16777215, 16777216, 16777217, 600_000_001, 2**40 + 2**20 + 1, 2**53 - 1]
    frame = spark.createDataFrame([(k, 300) for k in keys], "o_orderkey long, o_custkey long")
    frame.write.parquet(str(tmp_path / "orders.parquet"))
    rows = ply_colored_round_trip(spark, str(tmp_path)).collect()
    assert sorted((r.x, round(r.g * 255)) for r in rows) == [(float(k), k % 256) for k in keys]


def test_label_rasters_of_all_images(spark, tmp_path):
    """Every stored image is read back, not two of them."""
    import __spark_entry__ as entry

    rows = [(k, 14 * k + 1, "O") for k in range(500)]
    frame = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string")
    frame.write.parquet(str(tmp_path / "orders.parquet"))
    found = entry.queries()["label_rasters_all_round_trip"](spark, str(tmp_path)).collect()
    assert {r.image for r in found} == {0, 1, 2, 3, 4}
    assert len(found) == sum((14 * k + 1) % 13 > 0 for k in range(500))


def test_configuration_is_stored_and_read_by_entry(spark, tmp_path):
    """Tables that grow become one line an entry in several files, no row holds them whole."""
    from rasterloom.sources import scenes
    from workloads import io_queries

    n = 1000
    part = spark.range(n).select(F.col("id").alias("p_partkey"), F.concat(F.lit("n \"[x] "), "id").alias("p_name"), F.lit(None).cast("string").alias("p_brand"))
    stored = io_queries._entries(part.repartition(3), "p_partkey", F.array("p_name", "p_brand"), str(tmp_path / "prompts"))
    assert spark.read.text(stored).count() == n and len(list((tmp_path / "prompts").glob("part-*"))) == 3
    back = {r.class_id: list(r.prompts) for r in configs.read_class_prompts(spark, stored, lines=True).collect()}
    assert back == {i: [f'n "[x] {i}', None] for i in range(n)}
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "1.txt").write_text('{"a": {"type": "Window", "parent": null}, "c": {"parent": "b"}}\n\n')
    (tmp_path / "e" / "2.txt").write_text('{"b": {"parent": "a"}}\n')
    found = configs.read_entities(spark, str(tmp_path / "e"), lines=True).collect()
    assert {tuple(r) for r in found} == {("a", "Window", None), ("b", "", "a"), ("c", "", "b")} and len(found) == 3
    pose = {"camera_angle_x": 0.8, "frames": [{"file_path": "r_0", "transform_matrix": np.eye(4).tolist()}]}
    lines = [json.dumps(pose | {"frames": [pose["frames"][0] | {"file_path": f"r_{i}"}]}) for i in (2, 0, 1)]
    (tmp_path / "t.json").write_text("\n".join(lines))
    seen = scenes.read_transform_cameras(spark, str(tmp_path / "t.json"), 800, 600, lines=True).collect()
    assert {(r.uid, r.image) for r in seen} == {(i, f"r_{i}") for i in range(3)}


@pytest.mark.parametrize("name", ["class_prompts_file", "entities_file", "transform_cameras_file"])
def test_growing_tables_are_not_gathered(spark, monkeypatch, name):
    """What these queries store has a line for each row."""
    from workloads import io_queries

    counts, store_lines = [], io_queries._lines
    monkeypatch.setattr(io_queries, "_lines", lambda df, target: counts.append(df.count()) or store_lines(df, target))
    rows = getattr(io_queries, name)(spark, "/root/testdata/sf0.001").count()
    assert counts == [rows] and rows > 1


@pytest.mark.parametrize("width, block, most", [(2, 10, 40), (1024, 20, 40)])
def test_blocks_of_instances_are_bounded(spark, monkeypatch, width, block, most):
    """More instances, or longer vectors, give more groups, and not larger ones."""
    monkeypatch.setattr(instances, "INSTANCE_BLOCK", block)
    sizes, call = [], type(spark.range(1).groupBy("id")).cogroup

    def cogroup(left, right):
        sizes.extend(r["count"] for r in left.count().collect())
        return call(left, right)

    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "cogroup", cogroup)
    vectors = [[float((i * 7 + j) % 5 + 1) + i % 3 * j / width for j in range(width)] for i in range(400)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "instance_id int, feature array<double>")
    classes = spark.createDataFrame([(c, vectors[c]) for c in range(3)], "class_id int, feature array<double>")
    got = {r.instance_id: r for r in instances.classify_instances(rows, classes, -1.0).collect()}
    assert sum(sizes) == len(got) == 400 and max(sizes) <= most
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = unit @ np.array(vectors[:3]).T
    assert np.allclose([got[i].score for i in range(400)], scores.max(axis=1), rtol=1e-6)
