"""Files written here, read back, and compared with what went in."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.paths import stem
from rasterloom.operators import camera
from rasterloom.sinks import ply, tables
from rasterloom.sources import configs, points, rasters, scenes


def las_file(path, xyz, classes, kind=1, minor=2):
    width = {1: 28, 6: 30}[kind]
    size = 375 if minor >= 4 else 227
    head = bytearray(size)
    head[:4] = b"LASF"
    head[24], head[25] = 1, minor
    struct.pack_into("<H", head, 94, size)
    struct.pack_into("<I", head, 96, size)
    head[104] = kind
    struct.pack_into("<H", head, 105, width)
    struct.pack_into("<I", head, 107, len(xyz) if minor < 4 else 0)
    struct.pack_into("<3d", head, 131, 0.01, 0.01, 0.001)
    struct.pack_into("<3d", head, 155, 100.0, 200.0, 0.0)
    if minor >= 4:
        struct.pack_into("<Q", head, 247, len(xyz))
    body = bytearray()
    for (x, y, z), c in zip(xyz, classes):
        record = bytearray(width)
        struct.pack_into("<3i", record, 0, x, y, z)
        if kind == 1:
            record[15] = c | 0x80  # a flag bit above the class
        else:
            record[16] = c
        body += record
    path.write_bytes(bytes(head) + bytes(body))


@pytest.mark.parametrize("kind,minor", [(1, 2), (6, 4)])
def test_las_split_into_ranges(spark, tmp_path, kind, minor):
    xyz = [(i, -i, i * 10) for i in range(1000)]
    las_file(tmp_path / "a.las", xyz, [i % 20 for i in range(1000)], kind, minor)
    las_file(tmp_path / "b.las", xyz[:7], [3] * 7, kind, minor)
    from rasterloom.sources import records

    records.register(spark)
    cloud = spark.read.format("las").option("splitbytes", "1000").load(str(tmp_path))
    assert cloud.rdd.getNumPartitions() > 20
    rows = {(r.src_file, r.point_idx): r for r in cloud.collect()}
    assert len(rows) == 1007
    row = rows[("a.las", 321)]
    assert (row.x, row.y, row.z) == pytest.approx((103.21, 196.79, 3.21))
    assert row["class"] == 321 % 20
    assert points.count_points(spark, str(tmp_path)) == 1007
    assert [r.path[-5:] for r in points.list_inputs(spark, str(tmp_path)).collect()] == ["a.las", "b.las"]
    with pytest.raises(FileNotFoundError):
        points.list_inputs(spark, str(tmp_path), (".laz",))


def test_compressed_las_is_refused(spark, tmp_path):
    las_file(tmp_path / "a.las", [(0, 0, 0)], [1])
    data = bytearray((tmp_path / "a.las").read_bytes())
    data[104] |= 0x80
    (tmp_path / "a.las").write_bytes(bytes(data))
    with pytest.raises(Exception, match="compressed"):
        points.count_points(spark, str(tmp_path))


def test_ply_round_trip_in_tiles(spark, tmp_path):
    cloud = spark.range(1000).select(
        (F.col("id") / 3.0).alias("x"), (-F.col("id") * 1.0).alias("y"), F.lit(2.5).alias("z"), (F.col("id") % 201).alias("class")
    )
    target = str(tmp_path / "out")
    ply.write_points(cloud.repartition(3), target, tile_rows=150)
    files = list((tmp_path / "out").rglob("*.ply"))  # below a run folder, named by a manifest
    assert len(files) >= 7 and not list((tmp_path / "out").rglob(".*"))
    back = points.read_points(spark, target, "ply")
    assert back.count() == 1000
    want = cloud.agg(F.sum("class"), F.round(F.sum(F.col("x").cast("float").cast("double")), 3)).first()
    got = back.agg(F.sum("class"), F.round(F.sum("x"), 3)).first()
    assert tuple(want) == tuple(got)
    ply.write_points(cloud.limit(10), target)
    assert points.read_points(spark, target, "ply").count() == 10
    ply.write_points(cloud.limit(5), target, mode="append")
    assert points.read_points(spark, target, "ply").count() == 15
    with pytest.raises(Exception, match="nothing"):
        points.read_points(spark, target, "ply", class_field="nothing")


def test_ply_big_endian_and_extra_elements(spark, tmp_path):
    head = (
        "ply\nformat binary_big_endian 1.0\ncomment made here\nelement vertex 3\nproperty double x\nproperty double y\n"
        "property double z\nproperty float scalar_Classification\nelement face 0\nproperty list uchar int vertex_indices\nend_header\n"
    )
    body = b"".join(struct.pack(">3df", i + 0.5, i, -i, 12.0) for i in range(3))
    (tmp_path / "a.ply").write_bytes(head.encode() + body)
    rows = points.read_points(spark, str(tmp_path / "a.ply"), "ply", "scalar_Classification").orderBy("point_idx").collect()
    assert [(r.x, r.z, r["class"]) for r in rows] == [(0.5, 0.0, 12), (1.5, -1.0, 12), (2.5, -2.0, 12)]


def test_colored_and_splats(spark, tmp_path):
    cloud = spark.createDataFrame([(1.0, 2.0, 3.0, 255, 0, 51)], "x double, y double, z double, r int, g int, b int")
    ply.write_colored(cloud, str(tmp_path / "c"))
    row = points.read_colored(spark, str(tmp_path / "c")).first()
    assert (row.r, row.g, row.b, row.nx) == pytest.approx((1.0, 0.0, 0.2, 0.0))

    splats = spark.createDataFrame(
        [(1.0, 2.0, 3.0, [0.1, 0.2, 0.3], [float(i) for i in range(9)], 0.5, [1.0, 2.0, 3.0], [1.0, 0.0, 0.0, 0.0])],
        "x float, y float, z float, f_dc array<float>, f_rest array<float>, opacity float, scale array<float>, rot array<float>",
    )
    ply.write_splats(splats, str(tmp_path / "s"), degree=1)
    back = points.read_splats(spark, str(tmp_path / "s"), degree=1).first()
    assert list(back.f_rest) == [float(i) for i in range(9)] and back.opacity == 0.5
    assert list(back.rot) == [1.0, 0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        points.read_splats(spark, str(tmp_path / "s"), degree=3)


def scene(folder, binary):
    folder.mkdir()
    cams = [(1, "PINHOLE", 640, 480, [500.0, 510.0, 320.0, 240.0]), (2, "SIMPLE_PINHOLE", 320, 240, [250.0, 160.0, 120.0])]
    images = [
        (7, [1.0, 0, 0, 0], [0.1, 0.2, 0.3], 1, "b one.jpg", [(1.5, 2.5, 10), (3.0, 4.0, -1)]),
        (8, [0.5**0.5, 0, 0, 0.5**0.5], [1.0, 2.0, 3.0], 2, "a.jpg", []),
    ]
    pts = [(10, 1.0, 2.0, 3.0, 9, 8, 7, 0.25, 2), (11, -1.0, 0.0, 4.5, 255, 0, 1, 1.5, 0)]
    ids = {"SIMPLE_PINHOLE": 0, "PINHOLE": 1}
    if binary:
        data = struct.pack("<Q", 2) + b"".join(
            struct.pack("<iiQQ", i, ids[m], w, h) + struct.pack(f"<{len(p)}d", *p) for i, m, w, h, p in cams
        )
        (folder / "cameras.bin").write_bytes(data)
        data = struct.pack("<Q", 2)
        for i, q, t, c, name, obs in images:
            data += struct.pack("<i7di", i, *q, *t, c) + name.encode() + b"\0" + struct.pack("<Q", len(obs))
            data += b"".join(struct.pack("<ddq", *o) for o in obs)
        (folder / "images.bin").write_bytes(data)
        data = struct.pack("<Q", 2) + b"".join(
            struct.pack("<Q3d3BdQ", *p) + b"\0" * (8 * p[-1]) for p in pts
        )
        (folder / "points3D.bin").write_bytes(data)
        return
    (folder / "cameras.txt").write_text(
        "# cameras\n" + "".join(f"{i} {m} {w} {h} {' '.join(map(str, p))}\n" for i, m, w, h, p in cams)
    )
    text = "# images\n"
    for i, q, t, c, name, obs in images:
        text += f"{i} {' '.join(map(str, q + t))} {c} {name}\n" + " ".join(f"{x} {y} {p}" for x, y, p in obs) + "\n"
    (folder / "images.txt").write_text(text)
    (folder / "points3D.txt").write_text(
        "# points\n" + "".join(" ".join(map(str, p[:8])) + " 1 2 3 4\n" for p in pts)
    )


@pytest.mark.parametrize("binary", [True, False])
def test_scene_files(spark, tmp_path, binary):
    folder = tmp_path / "scene one"
    scene(folder, binary)
    poses, lenses = scenes.read_scene(spark, str(folder))
    by_id = {r.image_id: r for r in poses.collect()}
    assert by_id[7].name == "b one.jpg" and by_id[7].tvec == [0.1, 0.2, 0.3]
    assert [tuple(o) for o in by_id[7].obs] == [(1.5, 2.5, 10), (3.0, 4.0, -1)]
    assert by_id[8].obs == []
    assert {r.camera_id: (r.model, r.params) for r in lenses.collect()}[2] == ("SIMPLE_PINHOLE", [250.0, 160.0, 120.0])
    cams = {r.image: r for r in scenes.load_cameras(spark, str(folder), 320, 120).collect()}
    assert (cams["b one.jpg"].fx, cams["b one.jpg"].fy, cams["b one.jpg"].cy) == (250.0, 127.5, 60.0)
    assert (cams["a.jpg"].fx, cams["a.jpg"].fy, cams["a.jpg"].width) == (250.0, 125.0, 320)
    assert (cams["a.jpg"].r00, cams["a.jpg"].r01, cams["a.jpg"].r10) == pytest.approx((0.0, -1.0, 1.0))
    reader = scenes.read_points3d_binary if binary else scenes.read_points3d_text
    got = {r.id: r for r in reader(spark, f"{folder}/points3D.{'bin' if binary else 'txt'}").collect()}
    assert (got[11].z, got[11].r, got[11].error) == (4.5, 255, 1.5) and got[10].b == 7


def test_scene_needs_its_files_and_a_pinhole(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scenes.read_scene(spark, str(tmp_path))
    scene(tmp_path / "s", False)
    text = (tmp_path / "s" / "cameras.txt").read_text().replace("SIMPLE_PINHOLE", "OPENCV")
    (tmp_path / "s" / "cameras.txt").write_text(text)
    with pytest.raises(Exception, match="unsupported camera model"):
        scenes.load_cameras(spark, str(tmp_path / "s")).collect()


def test_transform_cameras(spark, tmp_path):
    angle = 0.4
    c, s = np.cos(angle), np.sin(angle)
    c2w = np.array([[c, 0, s, 1.0], [0, 1, 0, 2.0], [-s, 0, c, 3.0], [0, 0, 0, 1]])
    (tmp_path / "t.json").write_text(
        json.dumps({"camera_angle_x": 0.8, "frames": [{"file_path": "./train/r_0", "transform_matrix": c2w.tolist()}]})
    )
    row = scenes.read_transform_cameras(spark, str(tmp_path / "t.json"), 800, 600).first()
    flipped = c2w.copy()
    flipped[:3, 1:3] *= -1
    w2c = np.linalg.inv(flipped)
    assert row.image == "r_0"
    got = [[row[f"r{i}{j}"] for j in range(3)] for i in range(3)]
    assert np.allclose(got, w2c[:3, :3]) and np.allclose([row.t0, row.t1, row.t2], w2c[:3, 3])
    assert row.fx == pytest.approx(400 / np.tan(0.4))
    assert row.fov_y == pytest.approx(2 * np.arctan(300 / row.fx))


def test_rasters(spark, tmp_path):
    labels = np.array([[0, -1, 5], [7, 7, -1]], dtype=np.int64)
    np.save(tmp_path / "img1.npy", labels)
    got = {(r.y, r.x): r.label for r in rasters.read_label_rasters(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 0, (0, 2): 5, (1, 0): 7, (1, 1): 7}
    features = np.arange(24, dtype=np.float32).reshape(2, 4, 3)
    (tmp_path / "f").mkdir()
    np.save(tmp_path / "f" / "z.npy", features)
    rows = {(r.y, r.x): r.feature for r in rasters.read_feature_rasters(spark, str(tmp_path / "f")).collect()}
    assert rows[(1, 2)] == [18.0, 19.0, 20.0]
    assert tuple(rasters.detect_resolution(spark, str(tmp_path / "f")).first()) == (2, 4)
    with pytest.raises(Exception, match="height, width, channels"):
        rasters.detect_resolution(spark, str(tmp_path / "*.npy")).collect()


def test_pictures_and_instances(spark, tmp_path):
    import zlib

    def png(path, array):
        height, width = array.shape[:2]
        raw = b"".join(b"\0" + array[y].tobytes() for y in range(height))

        def chunk(kind, data):
            body = kind + data
            return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

        color = 0 if array.ndim == 2 else 2
        path.write_bytes(
            b"\x89PNG\r\n\x1a\n"
            + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw))
            + chunk(b"IEND", b"")
        )

    ids = np.array([[0, 3], [200, 3], [1, 1]], dtype=np.uint8)
    png(tmp_path / "a.png", ids)
    got = {(r.y, r.x): r.instance_id for r in rasters.read_instance_rasters(spark, str(tmp_path)).collect()}
    assert got == {(y, x): int(ids[y, x]) for y in range(3) for x in range(2)}
    rgb = np.array([[[255, 1, 2], [3, 4, 5]]], dtype=np.uint8)
    (tmp_path / "c").mkdir()
    png(tmp_path / "c" / "b.PNG", rgb)
    pixel = rasters.picture_pixels(rasters.read_pictures(spark, str(tmp_path / "c"))).filter("x = 0").first()
    assert (pixel.r, pixel.g, pixel.b) == (255, 1, 2)


def test_instance_features(spark, tmp_path):
    np.savez(tmp_path / "a.npz", features=np.eye(3, dtype=np.float32), ids=np.array([5, 5, 0]))
    got = sorted((r.instance_id, tuple(r.feature)) for r in rasters.read_instance_features(spark, str(tmp_path)).collect())
    assert got == [(0, (0, 0, 1)), (5, (0, 1, 0)), (5, (1, 0, 0))]
    (tmp_path / "m").mkdir()
    np.save(tmp_path / "m" / "m.npy", np.array([[1.0, 0], [0, 0], [0, 2]]))
    from rasterloom.operators.instances import usable_features

    rows = usable_features(rasters.read_instance_features(spark, str(tmp_path / "m"))).collect()
    assert [(r.instance_id, list(r.feature)) for r in rows] == [(2, [0.0, 1.0])]


def test_language_features(spark, tmp_path):
    from rasterloom.operators.features import segment_features

    np.save(tmp_path / "img_s.npy", np.array([[[0, 1], [-1, 1]], [[1, 1], [0, -1]]]))
    np.save(tmp_path / "img_f.npy", np.array([[1.0, 2.0], [3.0, 4.0]], dtype=np.float32))
    segments, features = rasters.read_language_features(spark, str(tmp_path))
    got = {(r.y, r.x): list(r.feature) for r in segment_features(segments, features, 1).collect()}
    assert got == {(0, 0): [3.0, 4.0], (0, 1): [3.0, 4.0], (1, 0): [1.0, 2.0]}


def test_configs(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    rates = put("r.json", {"_comment": "note", "_more": {"1": "x"}, "12": 0.9, "1": 0.05})
    assert configs.read_retention(spark, rates) == {12: 0.9, 1: 0.05}
    merge = put("m.json", {"9": [1, 5], "2": [9, 3]})
    assert list(configs.read_merge_map(spark, merge).items()) == [(9, [1, 5]), (2, [9, 3])]
    prompts = configs.read_class_prompts(spark, put("c.json", {"1": ["wall", "a [b]"], "2": "door"}))
    assert {r.class_id: list(r.prompts) for r in prompts.collect()} == {1: ["wall", "a [b]"], 2: ["door"]}
    assert configs.read_colors(spark, put("k.json", {"-1": [0, 0, 0], "3": [1, 2, 3]}))[3] == (1, 2, 3)
    frame = put("f.json", {"base_to_canonical": {"scale": [1, 1, 1], "shift": [-1.5, 2.0, 3.0], "swap_xy": False}})
    assert configs.read_frame_shift(spark, frame) == (-1.5, 2.0, 3.0)
    entities = configs.read_entities(spark, put("e.json", {"a": {"type": "Window", "parent": None}, "b": {"parent": "a"}}))
    assert {tuple(r) for r in entities.collect()} == {("a", "Window", None), ("b", "", "a")}
    link = configs.read_instance_entity(spark, put("i.json", {"4": "a"}))
    assert [tuple(r) for r in link.collect()] == [(4, "a")]
    assert configs.read_int_map(spark, str(tmp_path / "absent.json")).count() == 0


def test_tables(spark, tmp_path):
    pixels = spark.createDataFrame(
        [("a", 0, 1, 5), ("a", 600, 2, 6), ("b", 0, 0, 7)], "image string, y int, x int, label int"
    )
    target = str(tmp_path / "rasters")
    tables.write_label_rasters(pixels, target)
    assert {tuple(r) for r in tables.read_images(spark, target, ["a"]).collect()} == {("a", 0, 1, 5), ("a", 600, 2, 6)}
    dims = spark.createDataFrame([("b", 2, 3)], "image string, height int, width int")
    dense = {r.y: list(r.labels) for r in tables.dense_rasters(pixels.filter("image = 'b'"), dims).collect()}
    assert dense == {0: [7, -1, -1], 1: [-1, -1, -1]}

    old = spark.createDataFrame([("m1", 0.1), ("m2", 0.2)], "method string, iou double")
    new = spark.createDataFrame([("m2", 0.9)], "method string, iou double")
    tables.upsert_summary(old, str(tmp_path / "s1"), str(tmp_path / "none"))
    tables.upsert_summary(new, str(tmp_path / "s2"), str(tmp_path / "s1"))
    got = {r["method"]: r["iou"] for r in spark.read.json(str(tmp_path / "s2")).collect()}
    assert got == {"m1": 0.1, "m2": 0.9}


def test_stem(spark):
    names = spark.createDataFrame([("/a/b.c/d.e.png",), ("plain",), ("x/y/z.npy",)], "p string")
    assert [r[0] for r in names.select(stem(F.col("p"))).collect()] == ["d.e", "plain", "z"]


def test_camera_names(spark):
    cams = spark.createDataFrame([("a.JPG", 1), ("a.png", 2), ("b.png", 3)], "image string, k int")
    wanted = spark.createDataFrame([("a.png",), ("b.tif",)], "name string")
    assert {r.name: r.k for r in camera.find_camera(cams, wanted).collect()} == {"a.png": 2, "b.tif": 3}
    with pytest.raises(Exception, match="camera not found"):
        camera.find_camera(cams, spark.createDataFrame([("zz",)], "name string")).collect()
