"""Voxel choices as stream state, over several micro-batches, failures and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import sampling
from rasterloom.streaming import clouds, voxels

CLOUD = "src_file string, point_idx long, x double, y double, z double, class int"


def arrivals(spark, folder, files=6):
    rng = random.Random(4)
    for k in range(files):
        # later files hold lower classes for voxels that earlier ones have chosen already
        rows = [
            (rng.choice("ab"), 100 * (files - k) + i, *(rng.uniform(-9, 9) for _ in range(3)), rng.randint(0, files - k))
            for i in range(100)
        ]
        rows += rows[:3]
        spark.createDataFrame(rows, CLOUD).coalesce(1).write.mode("append").parquet(folder)


def points(df):
    return sorted(tuple(r[c] for c in ("src_file", "point_idx", "x", "y", "z", "class")) for r in df.collect())


def test_state_outlives_batches_and_failures(spark, tmp_path):
    folder, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    arrivals(spark, folder)
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def run(fail_at=None):
        stream = clouds.file_stream(spark, folder, CLOUD, files_per_trigger=1)
        if fail_at is not None:
            bad = F.raise_error(F.lit("executor lost")).cast("double")
            stream = stream.withColumn("x", F.when(F.col("point_idx") == fail_at, bad).otherwise(F.col("x")))
        voxels.start_voxel_ingest(stream, 3.0, target, state).awaitTermination()

    # the third file's points have ids from 400 on, so two batches are committed before the failure
    with pytest.raises(Exception, match="executor lost"):
        run(fail_at=450)
    partly = voxels.current_voxels(spark, target).count()
    assert 0 < partly
    run()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    seen = spark.read.schema(CLOUD).parquet(folder)
    want = points(sampling.voxel_downsample(seen, 3.0))
    assert points(voxels.current_voxels(spark, target)) == want
    # more files after another restart; chosen points of old voxels stay or give way to better ones
    late = [("0", 7, 0.5, 0.5, 0.5, 0), ("z", 9, 100.0, 0.0, 0.0, 9), ("z", 10, -8.9, 8.9, 0.0, 99)]
    spark.createDataFrame(late, CLOUD).coalesce(1).write.mode("append").parquet(folder)
    run()
    got = points(voxels.current_voxels(spark, target))
    assert got == points(sampling.voxel_downsample(spark.read.schema(CLOUD).parquet(folder), 3.0))
    assert late[0] in got and late[1] in got and len(got) >= len(want)
    changes = spark.read.parquet(target)
    assert changes.select("batch").distinct().count() >= 5
    assert changes.groupBy("vx", "vy", "vz").count().filter("count > 1").count() > 0
    # a run without new files changes nothing
    run()
    assert points(voxels.current_voxels(spark, target)) == got


def test_size_must_be_positive(spark):
    with pytest.raises(ValueError, match="positive"):
        voxels.voxel_changes(spark.createDataFrame([], CLOUD), 0.0)
