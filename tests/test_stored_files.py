"""Manifests, array files and ordered tables."""

import types

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.operators import raster
from rasterloom.sinks import manifest, npy, ordered, ply
from rasterloom.sources import points, rasters, records

PIXELS = "image string, y int, x int, label int"
DIMS = "image string, height int, width int"


def cloud(spark, n):
    return spark.range(n).select(
        F.col("id").cast("float").alias("x"), F.lit(0.0).cast("float").alias("y"), F.lit(0.0).cast("float").alias("z"),
        (F.col("id") % 7).cast("smallint").alias("class"),
    )


def stored(spark, folder):
    return sorted(r.x for r in points.read_points(spark, folder, "ply").collect())


@pytest.mark.parametrize("step", ["before", "publish", "move", "cleanup"])
@pytest.mark.parametrize("mode", ["overwrite", "append"])
def test_a_failed_commit_keeps_the_old_cloud(spark, tmp_path, monkeypatch, step, mode):
    """A commit that breaks at any step leaves the old cloud whole or the new one, never a part."""
    records.register(spark)
    folder = str(tmp_path / "cloud")
    ply.write_ply(cloud(spark, 40).repartition(3), folder, uchar=("class",), tile_rows=9)
    old = stored(spark, folder)
    assert old == [float(i) for i in range(40)]
    new = cloud(spark, 5)
    writer = ply.PlyWriter(new.schema, {"path": folder, "uchar": "class"}, mode == "overwrite")
    context = types.SimpleNamespace(partitionId=lambda: 0, attemptNumber=lambda: 0)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: context)
    message = writer.write(iter(new.toArrow().to_batches()))
    monkeypatch.undo()
    assert stored(spark, folder) == old  # tasks are done, nothing is committed

    def broken(*args, **kwargs):
        raise OSError("store is gone")

    fs = pafs.LocalFileSystem()
    if step == "publish":
        monkeypatch.setattr(manifest, "publish", broken)
    if step in ("move", "cleanup"):
        real = fs
        fs = types.SimpleNamespace(
            **{n: getattr(real, n) for n in ("create_dir", "get_file_info", "open_input_file", "open_output_stream", "delete_dir")},
            move=broken if step == "move" else real.move,
            delete_file=broken if step == "cleanup" else real.delete_file,
        )
        monkeypatch.setattr(ply, "open_filesystem", lambda path: (fs, path))
    if step == "before":
        writer.abort([message])
    else:
        with pytest.raises(OSError, match="gone"):
            writer.commit([message])
    monkeypatch.undo()
    fresh = [float(i) for i in range(5)]
    want = old if step != "cleanup" else fresh if mode == "overwrite" else sorted(old + fresh)
    assert stored(spark, folder) == want
    # the next write mends what was left behind
    ply.write_ply(cloud(spark, 3), folder, mode, ("class",))
    assert stored(spark, folder) == ([0.0, 1.0, 2.0] if mode == "overwrite" else sorted([*want, 0.0, 1.0, 2.0]))


def test_only_committed_attempts_count(spark, tmp_path):
    records.register(spark)
    folder = tmp_path / "cloud"
    ply.write_ply(cloud(spark, 4).coalesce(1), str(folder))
    tile = next(folder.rglob("*.ply"))
    stray = tile.parent.parent / "000000-1"  # a lost executor's second attempt
    stray.mkdir()
    (stray / "tile-000000.ply").write_bytes(tile.read_bytes())
    assert stored(spark, str(folder)) == [0.0, 1.0, 2.0, 3.0]
    # files of other origin beside a manifest's folder still count from above it
    (tmp_path / "other.ply").write_bytes(tile.read_bytes())
    assert len(stored(spark, str(tmp_path))) == 8


def test_foreign_files_are_kept_by_appends_and_replaced_by_overwrites(spark, tmp_path):
    records.register(spark)
    ply.write_ply(cloud(spark, 4).coalesce(1), str(tmp_path / "a"))
    tile = next((tmp_path / "a").rglob("*.ply")).read_bytes()
    folder = tmp_path / "plain"
    folder.mkdir()
    (folder / "old.ply").write_bytes(tile)
    ply.write_ply(cloud(spark, 2), str(folder), "append")
    assert len(stored(spark, str(folder))) == 6
    ply.write_ply(cloud(spark, 2), str(folder))
    assert len(stored(spark, str(folder))) == 2 and not (folder / "old.ply").exists()


def test_array_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    records.register(spark)
    arrays = {"a": rng.integers(-1, 9, (37, 5)), "b c": rng.integers(-1, 9, (4, 300)), "none": np.full((3, 3), -1)}
    rows = [(n, int(y), int(x), int(a[y, x])) for n, a in arrays.items() for y, x in np.argwhere(a >= 0)]
    rows += [("a", 99, 0, 1), ("a", 0, -1, 1), ("a", 0, 0, None), ("unknown", 0, 0, 1)]
    pixels = spark.createDataFrame(rows, PIXELS).repartition(4)
    dims = spark.createDataFrame([(n, *a.shape) for n, a in arrays.items()], DIMS)
    for rows_ in (10, 1000):
        npy.write_rasters(pixels, dims, str(tmp_path / "out"), block_rows=rows_)
        names = sorted(p.name for p in (tmp_path / "out").rglob("*.npy"))
        assert len(names) == (6 if rows_ == 10 else 3)
        back = {(r.image, r.y, r.x): r.label for r in rasters.read_label_rasters(spark, str(tmp_path / "out")).collect()}
        assert back == {(n, y, x): int(a[y, x]) for n, a in arrays.items() for y, x in map(tuple, np.argwhere(a >= 0).tolist())}
        sizes = {r.image: (r.height, r.width) for r in rasters.read_raster_dims(spark, str(tmp_path / "out")).collect()}
        assert sizes == {n: a.shape for n, a in arrays.items()}
    whole = np.load(next((tmp_path / "out").rglob("a.npy")))
    assert (whole == arrays["a"]).all()
    bad = pixels.select(F.lit("a/b").alias("image"), "y", "x", "label")
    with pytest.raises(Exception, match="cannot be named"):
        npy.write_rasters(bad, spark.createDataFrame([("a/b", 40, 400)], DIMS), str(tmp_path / "bad"))
    # the failed write left the folder as it was
    assert not list((tmp_path / "bad").rglob("*.npy"))


def test_vector_files(spark, tmp_path):
    records.register(spark)
    rows = [("i", y, x, [y + 0.5, x * 2.0, 7.0]) for y in range(6) for x in range(4) if (x + y) % 3]
    pixels = spark.createDataFrame(rows, "image string, y int, x int, v array<float>").repartition(3)
    dims = spark.createDataFrame([("i", 6, 4)], DIMS)
    npy.write_rasters(pixels, dims, str(tmp_path / "v"), "v", 0.0, channels=3)
    back = {(r.y, r.x): list(r.feature) for r in rasters.read_feature_rasters(spark, str(tmp_path / "v")).collect()}
    assert len(back) == 24 and all(back[y, x] == v for _, y, x, v in rows) and back[0, 0] == [0.0, 0.0, 0.0]
    with pytest.raises(Exception, match="not 2 wide"):
        npy.write_rasters(pixels, dims, str(tmp_path / "w"), "v", 0.0, channels=2)


@pytest.mark.parametrize("kind", ["json", "parquet"])
def test_ordered_tables(spark, tmp_path, kind):
    rows = [(f"n{(i * 37) % 500:04d}", i % 3) for i in range(500)] + [("n0001", 9), ("n0001", 1), (None, 5)]
    df = spark.createDataFrame(rows, "name string, v int").repartition(6)
    folder = str(tmp_path / "o")
    ordered.write_ordered(df, folder, ["name"], kind, files=5)
    assert len(list((tmp_path / "o").glob("part-*"))) > 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # a file is read by several tasks
    try:
        back = ordered.read_ordered(spark, folder, "name string, v int", kind).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r.name, r.v) for r in sorted(back, key=lambda r: r.position)] == want
    assert sorted(r.position for r in back) == list(range(len(rows)))
    with pytest.raises(ValueError):
        ordered.write_ordered(df, folder, ["name"], "csv")


def test_pixels_outside_their_image(spark):
    dims = spark.createDataFrame([("i", 2, 2)], DIMS)
    raster.require_inside(spark.createDataFrame([("i", 1, 1, 5)], PIXELS), dims)
    for row in (("i", 2, 0, 5), ("i", 0, 2, 5), ("j", 0, 0, 5)):
        with pytest.raises(ValueError, match="outside"):
            raster.require_inside(spark.createDataFrame([row], PIXELS), dims)
