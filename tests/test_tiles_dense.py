"""Runs, erosion and distance transform inside tiles."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import dense, neighborhood, raster, runs


def brute_nearest(source, radius):
    ys, xs = np.nonzero(source)
    out = {}
    for y, x in np.ndindex(*source.shape):
        near = [((a - y) ** 2 + (b - x) ** 2, a, b) for a, b in zip(ys.tolist(), xs.tolist())]
        near = [n for n in near if n[0] <= radius * radius]
        if near:
            # on a tie the uppermost line, and in a line the left one
            away, line, column = min(near)
            out[y, x] = (line, column, away)
    return out


@pytest.mark.parametrize("share", [0.02, 0.15, 0.5, 0.95])
def test_nearest_source_is_exact(share):
    rng = np.random.default_rng(int(share * 100))
    for _ in range(60):
        source = rng.random(rng.integers(1, 15, 2)) < share
        radius = int(rng.integers(0, 10))
        line, column, away = dense.nearest_source(source, radius)
        got = {at: (line[at], column[at], away[at]) for at in np.ndindex(*source.shape) if away[at] < dense.FAR}
        assert got == brute_nearest(source, radius)


def test_nearest_source_does_not_grow_with_the_radius():
    # every line has a source within 5 of most cells, so both radii keep all parabolas
    source = np.random.default_rng(1).random((300, 300)) < 0.3

    def seconds(radius):
        best = 1e9
        for _ in range(5):
            start = time.perf_counter()
            dense.nearest_source(source, radius)
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(40) < 1.3 * seconds(5) + 0.02


@pytest.mark.parametrize("reach", [1, 2, 5])
def test_interior_equals_square_windows(reach):
    rng = np.random.default_rng(reach)
    for _ in range(20):
        codes = np.kron(rng.integers(-1, 3, (3, 4)), np.ones((6, 7), int))
        padded = np.pad(codes, reach, constant_values=-2)
        want = np.ones(codes.shape, bool)
        for dy in range(2 * reach + 1):
            for dx in range(2 * reach + 1):
                want &= padded[dy : dy + codes.shape[0], dx : dx + codes.shape[1]] == codes
        assert (dense.interior(codes, reach) == (want & (codes >= 0))).all()


def pixels(spark, array, image="i"):
    rows = [(image, int(y), int(x), int(array[y, x])) for y, x in np.argwhere(array >= 0)]
    return spark.createDataFrame(rows, "image string, y int, x int, label int").repartition(4)


def test_runs_and_not_pixels_are_shuffled(spark):
    array = np.kron(np.arange(6).reshape(2, 3), np.ones((40, 50), int))
    table = raster.align_layers({"gt": pixels(spark, array), "pred": pixels(spark, array)}, lines=True)
    made = runs.label_runs(table, ["gt", "pred"])
    # three runs a line, and at most one more where a batch ends
    assert array.shape[0] * 3 <= made.count() <= array.shape[0] * 3 + 80
    assert made.agg(F.sum(F.col("x1") - F.col("x0") + 1)).first()[0] == array.size
    outcomes = neighborhood.pixel_outcomes(table.withColumn("_d", F.lit(3)))
    plan = outcomes._jdf.queryExecution().toString()
    assert plan.count("FlatMapGroupsInArrow") >= 1
    counts = {(r.gt, r.gt_boundary): r.n for r in outcomes.collect()}
    assert counts == {(k, b): (34 * 44 if not b else 40 * 50 - 34 * 44) for k in range(6) for b in (False, True)}


def test_masks_may_overlap(spark):
    """One pixel in several masks, and the same pixel twice in one mask."""
    a, b = np.full((12, 12), -1), np.full((12, 12), -1)
    a[1:9, 1:9], b[4:12, 4:12] = 1, 2
    both = pixels(spark, a).union(pixels(spark, b)).union(pixels(spark, a))
    for tile in (4, 256):
        marked = neighborhood.mark_boundary(both.withColumn("_d", F.lit(2)), tile=tile).collect()
        inner = {(r.label, r.y, r.x) for r in marked if not r.boundary}
        want = {(1, y, x) for y in range(3, 7) for x in range(3, 7)} | {(2, y, x) for y in range(6, 10) for x in range(6, 10)}
        assert inner == want and len(marked) == 2 * 64


def test_empty_layers(spark):
    none = pixels(spark, np.full((2, 2), -1))
    assert neighborhood.mark_boundary(none.withColumn("_d", F.lit(1))).count() == 0
    dims = spark.createDataFrame([("i", 4, 4)], "image string, height int, width int")
    assert neighborhood.fill_nearest(none, dims, 3).count() == 0
    table = none.withColumnRenamed("label", "gt").withColumn("pred", F.lit(1)).withColumn("_d", F.lit(1))
    assert neighborhood.pixel_outcomes(table).count() == 0


def test_radius_larger_than_the_tile(spark):
    array = np.full((40, 30), -1)
    array[0, 0], array[39, 29] = 5, 6
    dims = spark.createDataFrame([("i", 40, 30)], "image string, height int, width int")
    out = {(r.y, r.x): (r.label, r.filled) for r in neighborhood.fill_nearest(pixels(spark, array), dims, 25, tile=8).collect()}
    want = brute_nearest(array >= 0, 25)
    assert {at: array[line, column] for at, (line, column, _) in want.items()} == {at: label for at, (label, _) in out.items()}
    assert out[0, 0] == (5, False) and out[0, 1] == (5, True)
