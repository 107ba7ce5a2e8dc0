"""Nearest hits by packed keys."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import camera, raster_hits

HITS = "image string, y int, x int, depth float, label int, src_file string, point_idx long"


def some_hits(n, seed=1):
    rng = random.Random(seed)
    depths = [0.5, 0.25, 1.0, 1.0000001, 3e8, 1e-30, 0.0]
    return [
        (rng.choice(["a", "b", None]), rng.randint(0, 9), rng.randint(0, 600), rng.choice(depths), rng.choice([1, 2, None]),
         rng.choice(["f2", "f10", None]), rng.choice([i, i, 1 << 45, None]))
        for i in range(n)
    ]


def brute(hits):
    best = {}
    for image, y, x, depth, label, file, point in hits:
        depth = float(np.float32(depth))
        key = (depth, file is not None, file or "", point is not None, point or 0)
        at = (image, y, x)
        if at not in best or key < best[at][0]:
            best[at] = (key, {label}, depth)
        elif key == best[at][0]:
            best[at][1].add(label)
    return {at: (labels, depth) for at, (_, labels, depth) in best.items()}


@pytest.mark.parametrize("gathered", [7, 1 << 20])
def test_nearest_per_pixel(spark, monkeypatch, gathered):
    """Small buffers send a pixel on several times and end inside tiles; the result is the same."""
    monkeypatch.setattr(raster_hits, "GATHERED", gathered)
    hits = some_hits(4000)
    want = brute(hits)
    rows = camera.zbuffer(spark.createDataFrame(hits, HITS).repartition(5)).collect()
    assert len(rows) == len(want)
    for r in rows:
        labels, depth = want[r.image, r.y, r.x]
        assert r.label in labels and r.depth == depth
    assert camera.zbuffer(spark.createDataFrame([], HITS)).collect() == []


def test_buffers_inside_tasks(monkeypatch):
    monkeypatch.setattr(raster_hits, "GATHERED", 50)
    hits = sorted(some_hits(900, 3), key=lambda h: (h[0] is not None, h[0] or ""))
    schema = pa.schema([("image", pa.string()), ("y", pa.int32()), ("x", pa.int32()), ("depth", pa.float32()), ("label", pa.int32()), ("src_file", pa.string()), ("point_idx", pa.int64())])
    names = schema.names
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, h)) for h in hits[i : i + 13]], schema) for i in range(0, 900, 13)]
    reduced = pa.Table.from_batches(raster_hits._reduce(iter(batches)))
    assert reduced.num_rows <= 900
    keyed = sorted(reduced.to_pylist(), key=lambda r: (r["image"] is not None, r["image"] or "", r["y"] // 256, r["x"] // 256))
    wide = schema.append(pa.field("_ty", pa.int32())).append(pa.field("_tx", pa.int32()))
    rows = [r | {"_ty": r["y"] // 256, "_tx": r["x"] // 256} for r in keyed]
    parts = [pa.RecordBatch.from_pylist(rows[i : i + 9], wide) for i in range(0, len(rows), 9)]
    final = pa.Table.from_batches(raster_hits._finish(iter(parts))).to_pylist()
    want = brute(hits)
    assert len(final) == len(want)
    assert all((r["label"] in want[r["image"], r["y"], r["x"]][0]) for r in final)


def test_depths_keep_their_order():
    depth = np.array([-np.inf, -3.0, -1e-30, -0.0, 0.0, 1e-40, 1e-30, 0.5, 3e38, np.inf], np.float32)
    bits = raster_hits._depth_bits(depth)
    assert (np.diff(bits) >= 0).all() and bits[3] == bits[4] and len(set(bits.tolist())) == 9


def test_no_sort_aggregate(spark):
    plan = camera.zbuffer(spark.createDataFrame(some_hits(10), HITS))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1


def test_blocks_cover_every_visible_point(spark):
    """Cameras of any pose: each point that projects into one lies in one of its cells."""
    rng = np.random.default_rng(5)
    cams = []
    for i in range(12):
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        cams.append((f"c{i}", 64, 48, 60.0, 55.0, 32.0, 24.0, *map(float, turn.ravel()), *map(float, rng.normal(0, 5, 3))))
    cams.append(("nan", 64, 48, float("nan"), 55.0, 32.0, 24.0, *[1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 0.0, 0.0, 0.0))
    cameras = spark.createDataFrame(
        cams, "image string, width int, height int, " + ", ".join(f"{n} double" for n in camera.CAMERA_COLUMNS[3:])
    )
    rows = [("f", i, *map(float, p), 1) for i, p in enumerate(rng.normal(0, 6, (800, 3)))]
    rows += [("f", 9001, float("nan"), 0.0, 0.0, 1), ("f", 9002, float("inf"), 0.0, 0.0, 1)]
    cloud = spark.createDataFrame(rows, "src_file string, point_idx long, x double, y double, z double, class int")
    got = {(r.image, r.point_idx) for r in camera.project_points(cloud, cameras, 0.5, 9.0).collect()}
    plain = camera._to_pixels(cloud.join(F.broadcast(cameras)), 0.5, 9.0)
    assert got == {(r.image, r.point_idx) for r in plain.select("image", "point_idx").collect()} and len(got) > 100
