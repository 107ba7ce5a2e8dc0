"""Small hand-made inputs: ties, edges, empty cases, and properties that must hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import colors, crs, labels, vectors
from rasterloom.operators import (
    camera,
    features,
    hierarchy,
    instances,
    inventory,
    joins,
    knn,
    metrics,
    neighborhood,
    points,
    raster,
    sampling,
    tiles,
)

PIXELS = "image string, y int, x int, label int"
CLOUD = "src_file string, point_idx bigint, x double, y double, z double, class int"
DIMS = "image string, height int, width int"


def pixels_of(spark, image, array, name="label"):
    rows = [(image, int(y), int(x), int(array[y, x])) for y, x in zip(*np.nonzero(array >= 0))]
    return spark.createDataFrame(rows, PIXELS).withColumnRenamed("label", name)


def grid(df, shape, value="label", empty=-1):
    out = np.full(shape, empty)
    for r in df.collect():
        out[r["y"], r["x"]] = r[value]
    return out


def one_value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# --- labels -----------------------------------------------------------------------


def test_sequential_and_simultaneous_merges_differ(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "c int")
    chain = {2: [1], 3: [2], 5: [3]}
    got = [r[0] for r in df.select(labels.merge_sequential(F.col("c"), chain)).collect()]
    assert got == [0, 5, 5, 5, 4, 5]
    got = [r[0] for r in df.select(labels.remap_simultaneous(F.col("c"), {1: 2, 2: 3, 3: 5})).collect()]
    assert got == [0, 2, 3, 5, 4, 5]


def test_shipped_merge_map_removes_kept_classes():
    closure = labels.merge_closure({1: [1, 5, 6, 7, 8, 13], 200: [1, 2, 3, 12, 5, 6, 7, 8, 13]})
    assert set(closure.values()) == {200} and {1, 2, 3, 12} <= set(closure)


def test_fuse_is_idempotent_and_prefers_the_first(spark):
    a = pixels_of(spark, "i", np.array([[1, -1], [2, -1]]))
    b = pixels_of(spark, "i", np.array([[9, 8], [-1, -1]]))
    assert grid(raster.fuse_priority(a, b), (2, 2)).tolist() == [[1, 8], [2, -1]]
    assert sorted(raster.fuse_priority(a, a).collect()) == sorted(a.collect())


def test_split_layers_zero_is_empty(spark):
    primary = pixels_of(spark, "i", np.array([[1, 5, 0], [5, -1, 2]]))
    secondary = pixels_of(spark, "i", np.array([[101, 101, 0], [0, 103, 101]]))
    rows = {(r.y, r.x): (r.kept, r.filled, r.fused) for r in raster.split_layers(primary, secondary, [1, 2]).collect()}
    assert rows[(0, 0)] == (1, None, 1)
    assert rows[(0, 1)] == (None, 101, 101)
    assert rows[(0, 2)] == (None, None, 0)
    assert rows[(1, 0)] == (None, None, 5)
    assert rows[(1, 1)] == (None, 103, 103)
    assert rows[(1, 2)] == (2, None, 2)


def test_binary_and_levels(spark):
    df = spark.createDataFrame([(None,), (1,), (101,), (7,)], "c int")
    got = df.select(
        labels.to_binary(F.col("c"), [1]).alias("b"), labels.collapse_levels(F.col("c"), [1], [101, 1]).alias("l")
    ).collect()
    assert [tuple(r) for r in got] == [(None, None), (1, 200), (0, 201), (0, None)]


def test_palette_order(spark):
    color = lambda c: list(one_value(spark, colors.palette_color(F.lit(c), {5: (1, 2, 3), 200: (9, 9, 9)})))
    assert color(200) == list(colors.POSITIVE_COLOR)
    assert color(5) == [1, 2, 3]
    assert color(17) == list(colors.FALLBACK_COLORS[1])


@pytest.mark.parametrize("source,target", [((3, 4), (6, 8)), ((5, 7), (3, 4)), ((2, 3), (5, 7))])
def test_resample_matches_index_rule(spark, source, target):
    array = np.arange(source[0] * source[1]).reshape(source)
    out = raster.resample_nearest(
        pixels_of(spark, "i", array),
        spark.createDataFrame([("i", *source)], DIMS),
        spark.createDataFrame([("i", *target)], DIMS),
    )
    ys = np.arange(target[0]) * source[0] // target[0]
    xs = np.arange(target[1]) * source[1] // target[1]
    assert (grid(out, target) == array[np.ix_(ys, xs)]).all()


# --- metrics ----------------------------------------------------------------------


def test_missing_predictions_count_and_absent_classes_do_not(spark):
    truth = pixels_of(spark, "i", np.array([[1, 1, 2], [2, 2, -1]]))
    pred = pixels_of(spark, "i", np.array([[1, -1, 7], [2, 1, 1]]))
    counts = metrics.class_counts(metrics.confusion(metrics.align_truth(truth, pred)))
    got = {r.class_id: (r.tp, r.fp, r.fn, r.tn) for r in counts.collect()}
    assert got == {1: (1, 1, 1, 2), 2: (1, 0, 2, 2)}
    for c in got.values():
        assert sum(c) == 5
    scores = metrics.class_metrics(counts).collect()
    for r in scores:
        assert r.iou <= min(r.precision, r.recall) + 1e-12


def test_binary_of_nothing_gives_no_row(spark):
    empty = spark.createDataFrame([], "image string, gt int, pred int")
    assert metrics.binary_counts(empty).count() == 0


# --- neighbourhoods ---------------------------------------------------------------


def erode(mask, d):
    out = mask.copy()
    for _ in range(d):
        padded = np.pad(out, 1)
        out = np.min(
            [padded[1 + dy : 1 + dy + mask.shape[0], 1 + dx : 1 + dx + mask.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)],
            axis=0,
        )
    return out


@pytest.mark.parametrize("d", [1, 2, 3])
@pytest.mark.parametrize("tile", [8, 256])
def test_boundary_equals_iterated_erosion(spark, d, tile):
    rng = np.random.default_rng(d)
    array = np.kron(rng.integers(-1, 3, (5, 6)), np.ones((6, 5), dtype=int))
    array[rng.random(array.shape) < 0.01] = -1
    got = grid(
        neighborhood.mark_boundary(pixels_of(spark, "i", array).withColumn("_d", F.lit(d)), tile=tile).withColumn(
            "b", F.col("boundary").cast("int")
        ),
        array.shape,
        "b",
    )
    for label in range(3):
        mask = (array == label).astype(int)
        want = mask - erode(mask, d)
        assert ((got == 1) & (mask == 1)).astype(int).tolist() == want.tolist()


def test_boundary_width_rounds_half_to_even(spark):
    width = lambda h, w, r: one_value(spark, neighborhood.boundary_width(F.lit(h), F.lit(w), r))
    assert width(3, 4, 0.5) == 2 and width(3, 4, 0.7) == 4 and width(3, 4, 0.02) == 1


def nearest(array, radius, source):
    out = array.copy()
    ys, xs = np.nonzero(source)
    for y, x in zip(*np.nonzero(array < 0)):
        best = min(((sy - y) ** 2 + (sx - x) ** 2, sy, sx) for sy, sx in zip(ys, xs)) if len(ys) else None
        if best and best[0] <= radius * radius:
            out[y, x] = array[best[1], best[2]]
    return out


@pytest.mark.parametrize("tile", [8, 256])
@pytest.mark.parametrize("density", [0.05, 0.5, 0.97])
def test_fill_nearest_against_brute_force(spark, tile, density):
    rng = np.random.default_rng(7)
    array = np.where(rng.random((19, 23)) < density, rng.integers(0, 9, (19, 23)), -1)
    dims = spark.createDataFrame([("i", 19, 23)], DIMS)
    out = neighborhood.fill_nearest(pixels_of(spark, "i", array), dims, 4, tile=tile)
    got = grid(out, array.shape)
    assert (got == nearest(array, 4, array >= 0)).all()
    assert (got[array >= 0] == array[array >= 0]).all()


def test_fill_with_no_source_stays_empty(spark):
    dims = spark.createDataFrame([("i", 4, 4)], DIMS)
    assert neighborhood.fill_nearest(spark.createDataFrame([], PIXELS), dims, 3).count() == 0


def test_depth_edges_and_edge_aware_fill(spark):
    h, w, t = 14, 15, 0.3
    rng = np.random.default_rng(3)
    depth = np.where(np.arange(w)[None, :] < 7, 5.0, 9.0) + rng.random((h, w)) * 0.1
    covered = rng.random((h, w)) > 0.05
    array = np.where(covered, np.arange(h * w).reshape(h, w) % 50, -1)
    padded = np.pad(np.where(covered, depth, np.nan).astype(np.float32).astype(float), 1, constant_values=0.0)
    edge = np.zeros((h, w), dtype=bool)
    for y in range(h):
        for x in range(w):
            block = padded[y : y + 3, x : x + 3]
            gx = (block * np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])).sum()
            gy = (block * np.array([[-1, -2, -1], [0, 0, 0], [1, 2, 1]])).sum()
            top = np.nanmax(padded[max(y - 1, 0) : y + 4, max(x - 1, 0) : x + 4]) if covered.any() else 1
            edge[y, x] = np.hypot(gx, gy) / top > t
    grown = edge.copy()
    grown[1:] |= edge[:-1]
    grown[:-1] |= edge[1:]
    grown[:, 1:] |= edge[:, :-1]
    grown[:, :-1] |= edge[:, 1:]
    rows = [("i", int(y), int(x), int(array[y, x]), float(depth[y, x])) for y, x in zip(*np.nonzero(covered))]
    table = spark.createDataFrame(rows, "image string, y int, x int, label int, depth float")
    dims = spark.createDataFrame([("i", h, w)], DIMS)
    flagged = neighborhood.flag_depth_edges(table, dims, t, tile=8)
    got = grid(flagged.withColumn("e", F.col("edge").cast("int")), (h, w), "e")
    assert ((got == 1) == (grown & covered)).all()
    filled = grid(neighborhood.fill_edge_aware(table, dims, 3, t, tile=8), (h, w))
    assert (filled == nearest(array, 3, covered & ~grown)).all()


# --- cameras ----------------------------------------------------------------------


def look(spark, rows):
    return spark.createDataFrame(
        rows, "image string, width int, height int, fx double, fy double, cx double, cy double, "
        + ", ".join(f"{c} double" for c in (*[f"r{i}{j}" for i in range(3) for j in range(3)], "t0", "t1", "t2"))
    )


IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def test_projection_rules(spark):
    cam = look(spark, [("c", 4, 3, 1.0, 1.0, 0.0, 0.0, *IDENTITY, 0.0, 0.0, 0.0)])
    cloud = spark.createDataFrame(
        [
            ("f", 0, 2.0, 1.0, 2.0, 5),  # pixel (0, 1)
            ("f", 1, 2.0, 1.0, 2.0, 6),  # same place: the first point stays
            ("f", 2, -0.9, 0.0, 1.0, 7),  # u in (-1, 0) truncates to column 0
            ("f", 3, 9.0, 0.0, 1.0, 8),  # out of bounds
            ("f", 4, 0.0, 0.0, -1.0, 8),  # behind
            ("f", 5, 0.0, 0.0, 100.0, 8),  # at the limit: strict
            ("f", 6, 1e300, 0.0, 0.02, 8),  # overflows an int
            ("f", 7, 4.4, 2.2, 2.2, 9),  # pixel (1, 2)
            ("f", 8, 1.0, 1.0 / 2, 0.9999999999, 3),  # pixel (0, 1), nearest
        ],
        CLOUD,
    )
    near = camera.zbuffer(camera.project_points(cloud, cam, 0.01, 100.0))
    got = {(r.y, r.x): r.label for r in near.collect()}
    assert got == {(0, 1): 3, (0, 0): 7, (1, 2): 9}


def test_grid_pruning_keeps_every_visible_point(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(0, 20, (3000, 3))
    cloud = spark.createDataFrame(
        [("f", i, *map(float, p), int(i % 7)) for i, p in enumerate(pts)], CLOUD
    )
    rows, count = [], 0
    for k in range(6):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        t = rng.normal(0, 10, 3)
        rows.append((f"c{k}", 40, 30, 30.0 + k, 35.0, 20.0, 15.0, *map(float, q.ravel()), *map(float, t)))
        cam = pts @ q.T + t
        ok = cam[(cam[:, 2] > 0.5) & (cam[:, 2] < 30)]
        u = np.trunc((30.0 + k) * ok[:, 0] / ok[:, 2] + 20)
        v = np.trunc(35.0 * ok[:, 1] / ok[:, 2] + 15)
        count += int(((u >= 0) & (u < 40) & (v >= 0) & (v < 30)).sum())
    hits = camera.project_points(cloud, look(spark, rows), 0.5, 30.0)
    assert hits.count() == count
    near = camera.zbuffer(hits)
    assert near.groupBy("image", "y", "x").count().filter("count > 1").count() == 0
    worse = near.withColumnRenamed("depth", "d").join(hits, ["image", "y", "x"]).filter("depth < d")
    assert worse.count() == 0


def test_salted_projection_gives_the_same(spark, monkeypatch):
    cam = look(spark, [("c", 40, 30, 20.0, 20.0, 20.0, 15.0, *IDENTITY, 0.0, 0.0, 5.0)])
    cloud = spark.createDataFrame([("f", i, i % 9 - 4.0, i % 5 - 2.0, i % 3 + 0.0, 1) for i in range(90)], CLOUD)
    few = sorted(camera.project_points(cloud, cam).collect())
    monkeypatch.setattr(camera, "_BROADCAST_PAIRS", 0)
    assert sorted(camera.project_points(cloud, cam).collect()) == few and few


def test_extent_and_holdout(spark):
    cams = look(spark, [(n, 4, 3, 1.0, 1.0, 0.0, 0.0, *IDENTITY, x, 0.0, 0.0) for n, x in (("b", -2.0), ("a", 0.0), ("c", 2.0))])
    row = camera.camera_extent(cams).first()
    assert (row.center_x, row.radius) == pytest.approx((0.0, 2.2))
    split = {r.image: r.is_test for r in camera.holdout_split(cams, 2).collect()}
    assert split == {"a": True, "b": False, "c": True}


# --- sampling ---------------------------------------------------------------------


def cloud_of(spark, n, files=2):
    return spark.range(n).select(
        F.concat(F.lit("f"), F.col("id") % files).alias("src_file"),
        F.col("id").alias("point_idx"),
        (F.rand(1) * 10 - 5).alias("x"),
        (F.rand(2) * 10 - 5).alias("y"),
        (F.rand(3) * 10 - 5).alias("z"),
        F.when(F.col("id") % 3 == 0, 1).otherwise((F.col("id") % 5).cast("int")).alias("class"),
    )


def test_exact_quotas(spark):
    cloud = cloud_of(spark, 5000).cache()
    before = {r["class"]: r["count"] for r in cloud.groupBy("class").count().collect()}
    rates = {1: 0.05, 2: 0.0, 3: 1.7}
    kept = sampling.class_aware_sample(cloud, rates, 0.1, seed=5)
    after = {r["class"]: r["count"] for r in kept.groupBy("class").count().collect()}
    want = {c: int(n * min(1.0, rates.get(c, 0.1))) for c, n in before.items()}
    assert after == {c: n for c, n in want.items() if n}
    again = sampling.class_aware_sample(cloud.repartition(7), rates, 0.1, seed=5)
    assert sorted(r.point_idx for r in kept.collect()) == sorted(r.point_idx for r in again.collect())
    other = sampling.class_aware_sample(cloud, rates, 0.1, seed=6)
    assert {r.point_idx for r in other.collect()} != {r.point_idx for r in kept.collect()}
    assert sampling.uniform_sample(cloud, 0.2, seed=1).count() == 1000
    assert sampling.uniform_sample(cloud, 0.2, seed=1, scope=["src_file"]).count() == 1000
    assert sampling.uniform_sample(cloud, 0.0, seed=1).count() == 0
    assert sampling.uniform_sample(cloud, 1.0, seed=1).count() == 5000


def test_equal_keys_are_cut_by_position(spark):
    cloud = cloud_of(spark, 1000, files=1)
    kept = sampling.uniform_sample(cloud, 0.3, key=F.lit(5).cast("long"), key_bits=20)
    assert sorted(r.point_idx for r in kept.collect()) == list(range(300))


def test_published_class_counts_under_shipped_rates():
    counts = {12: 24642, 3: 288073, 13: 242680, 6: 1257928, 11: 1979855, 14: 1911652, 15: 1746219, 2: 3448050, 5: 6440977, 1: 19125652}
    rates = {12: 0.9, 3: 0.9, 13: 0.9, 6: 0.4, 11: 0.2, 14: 0.0, 15: 0.2, 2: 0.15, 5: 0.15, 1: 0.05}
    assert sum(counts.values()) == 36465728
    assert sum(int(n * rates[c]) for c, n in counts.items()) == 4187874


def test_voxel_rules(spark):
    cloud = spark.createDataFrame(
        [
            ("a", 0, 0.1, 0.1, 0.1, 5),
            ("a", 1, 0.2, 0.2, 0.2, 2),
            ("b", 0, 0.3, 0.3, 0.3, 2),
            ("a", 2, -0.1, 0.1, 0.1, 9),  # floors to another cube
            ("b", 1, 1.5, 0.0, 0.0, 1),
        ],
        CLOUD,
    )
    kept = sampling.voxel_downsample(cloud, 1.0)
    assert sorted((r.src_file, r.point_idx) for r in kept.collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted(sampling.voxel_downsample(kept, 1.0).collect()) == sorted(kept.collect())
    assert sampling.voxel_downsample(cloud, 0.0).count() == 5
    per_file = sampling.voxel_downsample(cloud, 1.0, scope=["src_file"])
    assert per_file.count() == 4


def test_strategies(spark):
    cloud = cloud_of(spark, 200)
    with pytest.raises(ValueError):
        sampling.downsample(cloud, "thin")
    with pytest.raises(ValueError):
        sampling.downsample(cloud, "uniform")
    assert sampling.downsample(cloud, "none").count() == 200
    both = sampling.downsample(cloud, "voxel+class_aware", voxel_size=2.0, default_rate=0.5, seed=1)
    assert 0 < both.count() < sampling.voxel_downsample(cloud, 2.0).count()


def test_affine_order(spark):
    cloud = spark.createDataFrame([("f", 0, 1.0, 2.0, 10.0, 1)], CLOUD)
    row = points.affine(cloud, 0.5, (2.0, 3.0, 4.0), (10.0, 20.0, 30.0), 0.25).first()
    assert (row.x, row.y, row.z) == (12.0, 26.0, 50.25)


def test_projection_formulas_against_published_points(spark):
    # Snyder, USGS PP 1395: conic on the Clarke 1866 ellipsoid, and a UTM check point.
    clarke = crs.Ellipsoid(6378206.4, 294.978698214)
    conic = crs.LambertConic(lon0=-96.0, lat0=23.0, lat1=33.0, lat2=45.0, ellipsoid=clarke)
    x, y = conic.forward(np.array([-75.0]), np.array([35.0]))
    assert (x[0], y[0]) == pytest.approx((1894410.9, 1564649.5), abs=0.1)
    tm = crs.TransverseMercator(lon0=-75.0, ellipsoid=clarke, false_east=0.0)
    x, y = tm.forward(np.array([-73.5]), np.array([40.5]))
    assert (x[0], y[0]) == pytest.approx((127106.5, 4484124.4), abs=0.1)
    for system in (conic, tm):
        lon, lat = system.inverse(*system.forward(np.array([-74.0]), np.array([41.25])))
        assert (lon[0], lat[0]) == pytest.approx((-74.0, 41.25), abs=1e-10)


# --- instances and embeddings -----------------------------------------------------


def test_hierarchy_with_cycle_and_orphan(spark):
    entities = spark.createDataFrame(
        [("b", "Building", None), ("w", "WallSurface", "b"), ("n", "Window", "w"), ("x", "Part", "n"),
         ("c1", "Loop", "c2"), ("c2", "RoofSurface", "c1"), ("o", "Door", "gone")],
        "entity_id string, type string, parent_id string",
    )
    got = {(r.type, r.entity_id) for r in hierarchy.descendants(entities, ["WallSurface", "RoofSurface", "Door"]).collect()}
    assert got == {("WallSurface", e) for e in "wnx"} | {("RoofSurface", "c1"), ("RoofSurface", "c2"), ("Door", "o")}
    link = spark.createDataFrame([(1, "x"), (2, "w"), (3, "c1"), (4, "o"), (5, "b")], "instance_id int, entity_id string")
    rows = hierarchy.hierarchy_labels(entities, link).collect()
    assert {r.instance_id: r.label for r in rows} == {1: 2, 2: 1, 3: 12, 4: 3}


def test_deep_chain(spark):
    rows = [("e0", "Window", None)] + [(f"e{i}", "Part", f"e{i - 1}") for i in range(1, 40)]
    entities = spark.createDataFrame(rows, "entity_id string, type string, parent_id string")
    assert hierarchy.descendants(entities, ["Window"]).count() == 40


def test_share_is_strict_and_counts_id_zero(spark):
    rows = [("i", 0, k, 4, int(k < 7)) for k in range(10)] + [("i", 1, k, 0, int(k < 8)) for k in range(10)]
    table = spark.createDataFrame(rows, "image string, y int, x int, instance_id int, mask int")
    assert [r.instance_id for r in instances.select_by_share(table, 0.7).collect()] == [0]


def test_box_rules(spark):
    ids = np.zeros((70, 70), dtype=int)
    ids[10:50, 10:50] = 3
    rows = [("i", int(y), int(x), int(ids[y, x])) for y in range(70) for x in range(70)]
    table = spark.createDataFrame(rows, "image string, y int, x int, instance_id int")
    boxes = spark.createDataFrame(
        [("i", 0, 1, 101, 9.5, 10.5, 50.0, 30.5, 0.5), ("i", 0, 2, 103, 10.0, 10.0, 30.0, 50.0, 0.5),
         ("i", 0, 3, 104, 60.0, 60.0, 60.0, 65.0, 0.9), ("i", 1, 1, 105, 0.0, 0.0, 69.0, 30.0, 0.5)],
        "image string, prompt_idx int, box_idx int, class_id int, x1 double, y1 double, x2 double, y2 double, score double",
    )
    got = {(r.prompt_idx, r.box_idx): r.overlap for r in instances.box_overlap(table, boxes).collect()}
    assert got == {(0, 1): 0.5, (0, 2): 0.5, (1, 1): 0.5}
    overlaps = instances.box_overlap(table, boxes)
    assert instances.vote_labels(overlaps, boxes).first().label == 101
    assert instances.vote_labels(overlaps, boxes, min_score=0.3).count() == 0


def test_override_and_unlabelled(spark):
    schema = "instance_id int, label int"
    base = spark.createDataFrame([(1, 5), (2, None)], schema)
    top = spark.createDataFrame([(1, 7), (3, 8)], schema)
    got = {r.instance_id: r.label for r in instances.override_labels(base, top).collect()}
    assert got == {1: 7, 2: None, 3: 8}


def test_vectors(spark):
    v = vectors.vec([3.0, 4.0])
    assert one_value(spark, vectors.norm(v)) == 5.0
    assert one_value(spark, vectors.l2_normalize(vectors.vec([0.0, 0.0]))) == [0.0, 0.0]
    assert sum(one_value(spark, vectors.softmax(vectors.vec([1.0, 2.0, 900.0])))) == pytest.approx(1.0)
    assert one_value(spark, vectors.argmax(vectors.vec([1.0, 7.0, 7.0]))) == 1
    pos, negs = 0.31, [0.1, 0.5, 0.2]
    want = min(np.exp(10 * pos) / (np.exp(10 * pos) + np.exp(10 * n)) for n in negs)
    assert one_value(spark, vectors.relevancy(vectors.vec([pos]), vectors.vec(negs)))[0] == pytest.approx(want)


def test_constant_relevancy_gives_confidence_zero(spark):
    rows = [("i", 0, x, [0.5, 0.2]) for x in range(3)]
    scored = spark.createDataFrame(rows, "image string, y int, x int, r array<double>")
    out = features.query_confidence(scored, {"r": 2}).collect()
    assert [(r.r_query, r.r_confidence) for r in out] == [(0, 0.0)] * 3
    single = scored.withColumn("r", F.slice("r", 1, 1))
    assert {r.r_confidence for r in features.query_confidence(single, {"r": 1}, use_softmax=True).collect()} == {1.0}


def test_no_candidate_classes(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "instance_id int, feature array<double>")
    none = spark.createDataFrame([], "class_id int, feature array<double>")
    assert instances.classify_instances(rows, none, 0.1).first().label is None


# --- windows, neighbours, files ---------------------------------------------------


@pytest.mark.parametrize("size,window,stride", [(20, 8, 6), (8, 8, 6), (5, 8, 6), (26, 8, 6), (9, 4, 4)])
def test_window_origins_cover_all(spark, size, window, stride):
    want = sorted(set(range(0, size, stride)) | {max(size - window, 0)})
    assert one_value(spark, tiles.window_origins(F.lit(size), window, stride)) == want
    for at in range(size):
        got = one_value(spark, tiles.covering_origins(F.lit(at), F.lit(size), window, stride))
        assert sorted(got) == [s for s in want if s <= at < s + window]


def test_initial_scale_against_brute_force(spark):
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.random((150, 3)) * 0.01, rng.random((60, 3)) * 50, [[9.0, 9, 9]] * 6, [[40.0, 1, 1]] * 2])
    rows = [tuple(map(float, p)) for p in pts]
    got = {(r.x, r.y, r.z): (r.copies, r.mean_sq) for r in knn.initial_scale(spark.createDataFrame(rows, "x double, y double, z double"), 1.0, split=16).collect()}
    for p in {tuple(p) for p in rows}:
        d2 = np.sort(((pts - np.array(p)) ** 2).sum(axis=1))[1:4]
        assert got[p][1] == pytest.approx(max(d2.mean(), 1e-7), rel=1e-9)
    assert got[(9.0, 9.0, 9.0)] == (6, 1e-7)


def test_few_points(spark):
    two = spark.createDataFrame([(0.0, 0.0, 0.0), (3.0, 4.0, 0.0)], "x double, y double, z double")
    assert {r.mean_sq for r in knn.initial_scale(two, 1.0).collect()} == {25.0}


def test_inventory_checks(spark):
    names = lambda *n: spark.createDataFrame([(v,) for v in n], "image string")
    inventory.require_complete(names("a", "b"), names("b", "a"))
    with pytest.raises(FileNotFoundError, match=r"1 images lack a layer: c \(primary\)"):
        inventory.require_complete(names("a"), names("a", "c"))
    with pytest.raises(FileNotFoundError):
        inventory.require_complete(names(), names())
    assert inventory.anchor_image(names("b", "a")).first().image == "a"
    assert inventory.anchor_image(names("b", "a"), "b").first().image == "b"
    with pytest.raises(Exception, match="anchor frame not found"):
        inventory.anchor_image(names("a"), "z").collect()
    required = spark.createDataFrame([("a", "rgb", "/a.png"), ("a", "rgb", "/a.jpg"), ("b", "rgb", "/b.png")], "image string, label string, path string")
    files = spark.createDataFrame([("/a.jpg",)], "path string")
    assert [r.image for r in inventory.missing_inputs(required, files).collect()] == ["b"]
    with pytest.raises(FileNotFoundError, match="model: 1 inputs missing"):
        inventory.require_inputs(required, files, "model")


def test_match_files(spark):
    names = spark.createDataFrame([("a_D",), ("b_depth",), ("c",), ("d",)], "name string")
    files = spark.createDataFrame([("/r/a.png",), ("/r/a.jpg",), ("/r/b_x.png",), ("/r/c.txt",)], "path string")
    got = {r["name"]: r["path"] for r in inventory.match_files(names, files, [".jpg", ".png"]).collect()}
    assert got == {"a_D": "/r/a.jpg", "b_depth": "/r/b_x.png", "c": None, "d": None}
    with pytest.raises(Exception, match="no file for"):
        inventory.match_files(names, files, [".jpg"], strict=True).collect()


def test_salted_join_keeps_rows(spark):
    big = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(1, "a"), (2, "b")], "k int, w string")
    assert joins.salted_join(big, small, ["k"]).count() == 1000
    assert joins.salted_join(big, small.filter("k = 2"), ["k"], "left").filter("w is null").count() == 1000
    assert joins.lookup_join(big, small, ["k"], max_rows=1).count() == 1000
    with pytest.raises(ValueError):
        joins.salted_join(big, small, ["k"], "full_outer")


def test_projection_of_odd_clouds(spark):
    cam = look(spark, [("c", 4, 3, 1.0, 1.0, 0.0, 0.0, *IDENTITY, 0.0, 0.0, 0.0)])
    empty = spark.createDataFrame([], CLOUD)
    assert camera.project_points(empty, cam).count() == 0
    odd = spark.createDataFrame(
        [("f", 0, float("nan"), 0.0, 1.0, 1), ("f", 1, float("inf"), 0.0, 1.0, 1), ("f", 2, 0.0, float("-inf"), 1.0, 1),
         ("f", 3, 1.0, 1.0, float("nan"), 1), ("f", 4, 1.0, 1.0, 1.0, 7)],
        CLOUD,
    )
    assert [(r.y, r.x, r.label) for r in camera.project_points(odd, cam).collect()] == [(1, 1, 7)]


def test_broadcast_check_counts_vectors(spark):
    wide = spark.range(100).select("id", F.array_repeat(F.lit(1.0), 1000).alias("v"), F.lit("abc").alias("s"))
    assert joins.fits_broadcast(wide, 100, 1_000_000)
    assert not joins.fits_broadcast(wide, 100, 700_000)
    assert not joins.fits_broadcast(wide, 99)
    assert joins.fits_broadcast(wide.filter("id < 0"))
