"""What must hold at every size: no side that grows is broadcast, partitions are not merged by compressed size."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rasterloom.operators import inventory, joins, knn, tiles
from rasterloom.sinks import ply
from rasterloom.sources import points, rasters, records


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_match_files_broadcasts_nothing(spark):
    names = spark.range(200).select(F.concat(F.lit("n"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, "_D").otherwise("")).alias("name"))
    files = spark.range(200).select(F.concat(F.lit("/r/n"), F.col("id").cast("string"), F.when(F.col("id") % 5 == 0, "_x.png").otherwise(".jpg")).alias("path"))
    out = inventory.match_files(names.union(names).union(spark.sql("SELECT CAST(NULL AS STRING)")), files, [".jpg", ".png"])
    plan = _plan(out)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    got = {r["name"]: r["path"] for r in out.collect()}
    assert len(got) == out.count() == 201 and got[None] is None
    # n5 is a prefix of several files: the first by path
    assert got["n2_D"] == "/r/n2.jpg" and got["n5"] == "/r/n50_x.png" and got["n10_D"] is None and got["n100_D"] is None


def test_stitched_partitions_are_not_merged(spark):
    scores = spark.range(6000).select(
        (F.col("id") % 2).cast("int").alias("image"),
        (F.col("id") % 40).cast("int").alias("y"),
        (F.floor(F.col("id") / 40) % 25).cast("int").alias("x"),
        (F.floor(F.col("id") / 1000) % 3).cast("int").alias("class_id"),
        (F.col("id") % 7 / F.lit(4.0)).alias("score"),
    )
    out = tiles.stitch_windows(scores)
    assert out.rdd.getNumPartitions() >= 200 and out.count() == 1000


def test_many_small_files_share_tasks(spark, tmp_path):
    records.register(spark)
    rows = spark.range(600).select(*[(F.col("id") / F.lit(2.0)).alias(a) for a in "xyz"], (F.col("id") % 9).alias("class"))
    ply.write_points(rows.repartition(2), str(tmp_path), tile_rows=2)
    back = points.read_points(spark, str(tmp_path), "ply")
    assert back.rdd.getNumPartitions() <= 3
    got = back.groupBy("src_file").agg(F.count("*").alias("n"), F.max("point_idx").alias("last")).collect()
    assert len(got) == 300 and {(r.n, r.last) for r in got} == {(2, 1)}
    assert sorted(r.x for r in back.collect()) == [i / 2 for i in range(600)]
    # a large file is still cut into ranges
    assert spark.read.format("ply").option("splitbytes", "100").load(str(tmp_path)).rdd.getNumPartitions() >= 300


def test_label_lines_are_read_together(spark, tmp_path):
    made = {"a": np.arange(-3, 21, dtype="<i4").reshape(6, 4), "b": np.arange(6, dtype="<i8").reshape(2, 3), "c": np.full((3, 2), -1, "<i2")}
    for name, array in made.items():
        np.save(tmp_path / f"{name}.npy", array)
    want = {(n, int(y), int(x), int(v)) for n, a in made.items() for (y, x), v in np.ndenumerate(a) if v >= 0}
    assert {tuple(r) for r in rasters.read_label_rasters(spark, str(tmp_path)).collect()} == want
    lines = [pa.RecordBatch.from_pydict({"image": ["a"] * 4 + ["b"] * 2, "line_no": [0, 1, 2, 3, 0, 1], "shape": [[4, 2]] * 4 + [[2, 3]] * 2, "kind": ["<i4"] * 6, "line": [np.arange(w, dtype="<i4").tobytes() for w in (2, 2, 2, 2, 3, 3)]})]
    assert [v.shape for _, _, _, v in rasters._line_blocks(iter(lines), np.int32)] == [(4, 2), (2, 3)]


def test_feature_lines_are_read_together(spark, tmp_path, monkeypatch):
    made = {"a": np.arange(24, dtype="<f4").reshape(3, 4, 2), "b": np.arange(30, dtype="<f8").reshape(2, 5, 3)}
    for name, array in made.items():
        np.save(tmp_path / f"{name}.npy", array)
    want = {(n, y, x): a[y, x].tolist() for n, a in made.items() for y, x in np.ndindex(a.shape[:2])}
    got = rasters.read_feature_rasters(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.image, r.y, r.x): r.feature for r in got} == want
    # a line longer than a block, and blocks of several lines
    line = pa.RecordBatch.from_pydict({"image": ["a"] * 3, "line_no": [4, 5, 6], "shape": [[7, 4, 2]] * 3, "kind": ["<f4"] * 3, "line": [np.arange(8, dtype="<f4").tobytes()] * 3})
    for rows, shapes in ((4, [(1, 8)] * 3), (16, [(2, 8), (1, 8)])):
        monkeypatch.setattr(rasters, "_ROWS", rows)
        assert [v.shape for _, _, _, v in rasters._line_blocks(iter([line]), np.float32)] == shapes


def test_neighbours_by_bounded_lists(spark, monkeypatch):
    monkeypatch.setattr(knn, "_LIST", 4)
    rng = np.random.default_rng(3)
    dense = rng.integers(0, 40, (120, 3)) / 64.0
    spots = np.concatenate([dense, dense[:5], rng.integers(-300, 300, (30, 3)) / 8.0, [[500.0, 0.0, 0.0]]])
    frame = spark.createDataFrame([tuple(map(float, p)) for p in spots], "x double, y double, z double")
    got = {(r.x, r.y, r.z): (r.copies, r.mean_sq) for r in knn.initial_scale(frame, 1.0).collect()}
    d2 = ((spots[:, None] - spots[None]) ** 2).sum(axis=2)
    assert len(got) == len(np.unique(spots, axis=0))
    for i, p in enumerate(spots):
        copies, mean = got[tuple(p)]
        assert copies == (d2[i] == 0).sum() and abs(mean - max(np.sort(d2[i])[1:4].mean(), knn.FLOOR)) < 1e-9
    others = spark.range(1000).select(F.lit(0.5).alias("_edge"), *[F.col("id").alias(o) for o in ("_ox", "_oy", "_oz")], F.lit(1).alias("_m"))
    lists = knn._lists(others, ["_edge"]).select(F.size("_others").alias("n")).collect()
    assert sum(r.n for r in lists) == 1000 and max(r.n for r in lists) < 20
    a, b = others.selectExpr("_ox AS k", "_oy AS v"), others.selectExpr("_ox AS k", "_oz AS w")
    many = joins.salted_join(a, b, ["k"], salts=2, many=True)
    assert many.rdd.getNumPartitions() >= 200 and many.filter("v = w").count() == 1000
