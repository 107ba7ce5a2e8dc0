"""Whole runs on small tables, stored and read back."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators.ranking import numbered
from rasterloom.plans import evaluate, fusion, ingest, masks, projection, run
from rasterloom.sources.rasters import read_prediction_cache
from rasterloom.streaming import clouds
from tests.test_operators import CLOUD, DIMS, IDENTITY, PIXELS, grid, look, pixels_of


class Fixed:
    """A predictor that returns a given raster."""

    def __init__(self, name, pixels, ending):
        self.name, self.pixels, self.ending = name, pixels, ending

    def required_inputs(self, images):
        from rasterloom.plans.predictors import required_paths

        return required_paths(images, "raster", [f"/in/{{}}{self.ending}"])

    def predict(self):
        positive = F.when(F.col("label") == 1, F.lit(1))
        return self.pixels.select("image", "y", "x", positive.alias("pred_binary"), F.col("label").alias("pred_class"))


def test_run_store_and_compare(spark, tmp_path):
    truth = np.array([[1, 1, 101], [1, -1, 101], [-1, 103, 103]])
    fill = np.where(truth < 0, 101, -1)
    pred = np.array([[1, 101, 101], [1, 1, 101], [103, 103, -1]])
    primary, secondary = pixels_of(spark, "a", truth), pixels_of(spark, "a", fill)
    dims = spark.createDataFrame([("a", 3, 3)], DIMS)
    good = Fixed("good", pixels_of(spark, "a", pred), ".png")
    full = Fixed("perfect", pixels_of(spark, "a", np.where(truth < 0, 101, truth)), ".npy")
    config = run.RunConfig(
        evaluate.EvaluationConfig({1: "wall", 101: "tree", 103: "person"}, positive_ids=(1,), negative_ids=(101, 103))
    )
    files = spark.createDataFrame([("/in/a.png",)], "path string")
    with pytest.raises(FileNotFoundError, match="perfect"):
        run.run_evaluation(primary, secondary, dims, [good, full], config, files)
    done = run.run_evaluation(primary, secondary, dims, [good, full], config)
    overall = {r.method: r for r in done.report_overall.collect()}
    assert overall["perfect"].pixel_acc == 1.0 and overall["perfect"].mean_iou == pytest.approx(1.0)
    assert overall["good"].pixel_acc == pytest.approx(5 / 9)
    binary = {r.method: r for r in done.report_binary.collect()}
    assert binary["good"].iou == pytest.approx(2 / 4)
    run.store(done, str(tmp_path / "out"), config)
    report = {r["method"]: r for r in spark.read.json(str(tmp_path / "out" / "report")).collect()}
    assert report["perfect"]["classes"]["tree"]["recall"] == pytest.approx(1.0)
    cache = read_prediction_cache(spark, str(tmp_path / "out" / "predictions"))
    assert cache.filter("method = 'good'").count() == 9  # a pixel without prediction has a row, too
    shown = run.comparison(cache, pixels_of(spark, "a", truth))
    assert shown.count() == 2 * int((truth >= 0).sum())
    lines = [json.loads(l) for f in (tmp_path / "out" / "stability").glob("*.json") for l in f.read_text().splitlines()]
    assert {l["method"] for l in lines} == {"good", "perfect"}
    run.store(done, str(tmp_path / "again"), config, str(tmp_path / "out" / "summary"))


def test_incomplete_truth_stops_a_run(spark):
    a, b = pixels_of(spark, "a", np.array([[1]])), pixels_of(spark, "b", np.array([[1]]))
    dims = spark.createDataFrame([("a", 1, 1)], DIMS)
    config = run.RunConfig(evaluate.EvaluationConfig({1: "wall"}))
    with pytest.raises(FileNotFoundError):
        run.run_evaluation(a, b, dims, [], config)


def test_prediction_of_another_size(spark):
    truth = np.kron(np.array([[1, 2], [3, 1]]), np.ones((2, 3), dtype=int))
    small = np.array([[1, 2], [3, 1]])
    pred = pixels_of(spark, "a", small).select("image", "y", "x", F.lit(None).cast("int").alias("pred_binary"), F.col("label").alias("pred_class"))
    none = spark.createDataFrame([], PIXELS)
    done = evaluate.evaluate(
        pixels_of(spark, "a", truth), none, spark.createDataFrame([("a", 4, 6)], DIMS), {"m": pred},
        evaluate.EvaluationConfig({1: "a", 2: "b", 3: "c"}, positive_ids=(1,)),
        {"m": spark.createDataFrame([("a", 2, 2)], DIMS)},
    )
    row = done.report_overall.first()
    assert (row.pixel_acc, row.mean_boundary_iou) == (1.0, 1.0)


def test_projection_plan(spark):
    cam = look(spark, [("c", 6, 5, 1.0, 1.0, 0.0, 0.0, *IDENTITY, 0.0, 0.0, 0.0)])
    cloud = spark.createDataFrame([("f", 0, 2.0, 2.0, 1.0, 4), ("f", 1, 5.0, 4.0, 1.0, 6)], CLOUD)
    filled = projection.project_cloud(cloud, cam, projection.ProjectionConfig(fill="nearest", fill_radius=1))
    got = grid(filled, (5, 6))
    assert got[2, 2] == 4 and got[1, 2] == 4 and got[4, 5] == 6 and (got >= 0).sum() == 8
    bare = projection.project_cloud(cloud, cam)
    assert bare.count() == 2
    with pytest.raises(ValueError):
        projection.project_cloud(cloud, cam, projection.ProjectionConfig(fill="DEFAULT"))
    report = projection.projection_report(filled, cam, "nearest").first()
    assert report.coverage_before == pytest.approx(2 / 30) and report.average_coverage_after == pytest.approx(8 / 30)
    assert report.classes == {4: 5, 6: 3}
    assert {r.label: list(r.color) for r in projection.color_table(filled, {4: (1, 2, 3)}).collect()}[-1] == [0, 0, 0]


def test_mask_transfer(spark):
    rows = [("a", 0, x, 5 if x < 3 else 6) for x in range(6)] + [("b", 1, x, 6) for x in range(2)] + [("b", 2, 0, 5)]
    pixels = spark.createDataFrame(rows, "image string, y int, x int, instance_id int")
    mask = spark.createDataFrame([(9, 0, x) for x in (0, 1, 2, 3, 4)], "class_id int, y int, x int")
    got = {(r.class_id, r.image, r.y, r.x) for r in masks.transfer_masks(pixels, mask).collect()}
    assert got == {(9, "a", 0, 0), (9, "a", 0, 1), (9, "a", 0, 2), (9, "b", 2, 0)}


def test_fusion_resizes_the_prediction(spark):
    projected = pixels_of(spark, "i", np.array([[1, 7, 0, 0]]))
    predicted = pixels_of(spark, "i", np.array([[4, 12]]))
    dims = spark.createDataFrame([("i", 1, 4)], DIMS)
    small = spark.createDataFrame([("i", 1, 2)], DIMS)
    rows = {r.x: (r.kept, r.filled, r.fused) for r in fusion.fuse_layers(projected, predicted, dims, predicted_dims=small).collect()}
    assert rows == {0: (1, None, 1), 1: (None, 101, 101), 2: (None, 103, 103), 3: (None, 103, 103)}


def test_streams(spark, tmp_path):
    config = ingest.IngestConfig(strategy="voxel", voxel_size=1.0, shift=(1.0, 0.0, 0.0))
    for k in range(3):
        rows = [("f", k * 10 + i, float(i % 2), 0.0, 0.0, k) for i in range(10)]
        spark.createDataFrame(rows, CLOUD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = clouds.file_stream(spark, str(tmp_path / "in"), CLOUD, files_per_trigger=1)
    clouds.start_ingest(stream, config, str(tmp_path / "all"), str(tmp_path / "s1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "all")).count() == 30
    clouds.start_sampled_ingest(stream, config, str(tmp_path / "few"), str(tmp_path / "s2")).awaitTermination()
    few = spark.read.parquet(str(tmp_path / "few"))
    assert few.count() == 6 and few.agg(F.min("x")).first()[0] == 1.0
    seen = []

    def store(batch, number):
        seen.append({r["class"]: (r.n_original, r.n_kept) for r in batch.collect()})

    counts = clouds.running_counts(stream, kept=F.col("point_idx") % 2 == 0)
    clouds.start_counts(counts, store, str(tmp_path / "s3")).awaitTermination()
    assert len(seen) == 3 and seen[-1] == {0: (10, 5), 1: (10, 5), 2: (10, 5)}


def test_chunked_ingest(spark):
    cloud = spark.createDataFrame([("f", i, 0.0, 0.0, 0.0, 1) for i in range(100)], CLOUD)
    config = ingest.IngestConfig(strategy="class_aware", default_rate=0.25, chunk_rows=30)
    kept = ingest.ingest(cloud, config)
    per_chunk = sorted(np.bincount([r.point_idx // 30 for r in kept.collect()]))
    assert per_chunk == [2, 7, 7, 7]
    report = {(r.src_file, r["class"]): r.n_kept for r in ingest.ingest_report(cloud, config).collect()}
    assert report == {("f", 1): 23, ("f", None): 23, (None, None): 23}


def test_numbered(spark):
    df = spark.range(500).select((500 - F.col("id")).alias("v")).repartition(9)
    rows = numbered(df, ["v"], "n").collect()
    assert sorted((r.v, r.n) for r in rows) == [(i + 1, i) for i in range(500)]
