"""Windows in blocks against one window after another."""

import numpy as np
import pytest

from rasterloom.operators import tiles

PIXELS = "image string, y int, x int, r int, g int"


def model(block):
    """Scores that differ by window: from its pixels, its size and its sum."""
    out = np.zeros((*block.shape[:2], 3), np.float32)
    out[..., 0] = block[..., 0] - block[..., 1]
    out[..., 1] = block.sum() % 7
    out[..., 2] = block.shape[0] * 2 - block.shape[1]
    return out


def brute(arrays, window, stride):
    means = {}
    for image, array in arrays.items():
        height, width = array.shape[:2]
        total = np.zeros((height, width, 3))
        count = np.zeros((height, width, 1))
        for y in sorted({*range(0, height, stride), max(height - window, 0)}):
            for x in sorted({*range(0, width, stride), max(width - window, 0)}):
                place = (slice(y, y + window), slice(x, x + window))
                total[place] += model(np.maximum(array[place], 0).astype(np.float32))
                count[place] += 1
        for y, x in np.argwhere(array[..., 0] >= 0).tolist():
            means[image, y, x] = total[y, x] / count[y, x]
    return means


@pytest.mark.parametrize("window,stride", [(8, 6), (5, 5), (7, 2), (6, 9), (40, 30)])
def test_blocks_equal_single_windows(spark, monkeypatch, window, stride):
    monkeypatch.setattr(tiles, "_BLOCK_SPAN", 12)
    rng = np.random.default_rng(window)
    arrays = {}
    for image, shape in (("a", (33, 41)), ("b", (3, 70)), ("c", (1, 1)), ("d", (26, 26))):
        array = rng.integers(0, 9, (*shape, 2))
        array[rng.random(shape) < 0.2] = -1
        arrays[image] = array
    rows = [(n, y, x, *map(int, a[y, x])) for n, a in arrays.items() for y, x in np.argwhere(a[..., 0] >= 0).tolist()]
    dims = spark.createDataFrame([(n, *a.shape[:2]) for n, a in arrays.items()], "image string, height int, width int")
    pixels = spark.createDataFrame(rows, PIXELS).repartition(4)
    want = brute(arrays, window, stride)
    covered = {k: v for k, v in want.items() if not np.isnan(v).any()}  # strides past the window leave gaps
    got = {(r.image, r.y, r.x): (r.label, r.score) for r in tiles.predict_labels(pixels, dims, model, ("r", "g"), window, stride).collect()}
    assert got.keys() == covered.keys()
    for k, (label, score) in got.items():
        assert score == pytest.approx(want[k].max(), abs=1e-4)
        assert want[k][label] == pytest.approx(want[k].max(), abs=1e-4)
    stitched = tiles.stitch_scores(tiles.predict_windows(pixels, dims, model, ("r", "g"), window, stride)).collect()
    assert {(r.image, r.y, r.x) for r in stitched} == covered.keys()
    assert all(r.score == pytest.approx(want[r.image, r.y, r.x].max(), abs=1e-4) for r in stitched)


@pytest.mark.parametrize("window,stride", [(800, 600), (8, 6), (100, 80)])
def test_copies_are_few(spark, window, stride):
    """Rows shuffled a pixel, over an image of many windows."""
    side = 40 * stride
    step = max(1, side // 300)
    rows = [("a", y, x, 1, 1) for y in range(0, side, step) for x in range(0, side, step)]
    pixels = spark.createDataFrame(rows[:: max(1, len(rows) // 20_000)], PIXELS)
    dims = spark.createDataFrame([("a", side, side)], "image string, height int, width int")
    span = stride * max(tiles._BLOCK_WINDOWS, -(-tiles._BLOCK_SPAN // stride))
    assert tiles._to_blocks(pixels, dims, window, stride, span).count() <= 1.5 * pixels.count()


def test_no_pixels(spark):
    none = spark.createDataFrame([], PIXELS)
    dims = spark.createDataFrame([("a", 9, 9)], "image string, height int, width int")
    assert tiles.predict_labels(none, dims, model, ("r", "g"), 8, 6).collect() == []
