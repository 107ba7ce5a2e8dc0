"""Binary scenes in ranges: borders, windows, and files that break off."""

import io
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import indexed, scenes


def point(i, tracks):
    return struct.pack("<Q3d3BdQ", i, i / 2, -i, 0.5, i % 256, 1, 2, i / 4, tracks) + struct.pack("<ii", i, 9) * tracks


def image(i, seen):
    name = ("é" * (i % 5) + f"{i}.png").encode()
    pose = struct.pack("<i7di", i, 1.0, 0.0, 0.0, i / 8, i, 2.0, 3.0, i % 3)
    return pose + name + b"\0" + struct.pack("<Q", len(seen)) + b"".join(struct.pack("<ddq", *o) for o in seen)


def whole(records):
    return struct.pack("<Q", len(records)) + b"".join(records)


@pytest.mark.parametrize("window", [1, 60, 1 << 20])
@pytest.mark.parametrize("every", [1, 7, 1000])
def test_ranges_meet_at_record_borders(window, every):
    rng = random.Random(every)
    records = [point(i, rng.choice([0, 0, 3, 200])) for i in range(60)]
    ends = np.cumsum([8, *map(len, records)]).tolist()
    found = list(indexed.file_ranges(io.BytesIO(whole(records)), scenes._point_length, every, 1 << 30, window))
    assert [low for *_, low, _ in found] + [found[-1][3]] == [ends[f] for f, *_ in found] + [ends[-1]]
    assert sum(n for _, n, *_ in found) == 60 and max(n for _, n, *_ in found) <= every
    records = [image(i, [(i + k, k, k) for k in range(rng.choice([0, 1, 50]))]) for i in range(40)]
    found = list(indexed.file_ranges(io.BytesIO(whole(records)), scenes._pose_length, every, 500, window))
    assert sum(n for _, n, *_ in found) == 40 and found[-1][3] == len(whole(records))


def test_broken_files():
    data = whole([point(i, 4) for i in range(20)])
    for cut in (len(data) - 1, len(data) - 40, 30, 9):
        with pytest.raises(OSError, match="shorter"):
            list(indexed.file_ranges(io.BytesIO(data[:cut]), scenes._point_length))
    assert list(indexed.file_ranges(io.BytesIO(whole([])), scenes._point_length)) == []


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(1)
    for scene, n in (("one", 500), ("two more", 1), ("none", 0)):
        (tmp_path / scene).mkdir()
        (tmp_path / scene / "points3D.bin").write_bytes(whole([point(i, rng.randint(0, 9)) for i in range(n)]))
    points = scenes.read_points3d_binary(spark, f"{tmp_path}/*/points3D.bin", every=20)
    rows = points.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows if r.scene.endswith("one")}) >= 5
    got = sorted((r.scene.rsplit("/", 1)[1], r.id, r.x, r.y, r.z, r.r, r.g, r.b, r.error) for r in rows)
    want = [("one", i, i / 2, -float(i), 0.5, i % 256, 1, 2, i / 4) for i in range(500)] + [("two more", 0, 0.0, 0.0, 0.5, 0, 1, 2, 0.0)]
    assert got == sorted(want)


def test_images_keep_names_and_observations(spark, tmp_path):
    rng = random.Random(2)
    seen = {i: [(rng.random(), rng.random(), rng.randint(-1, 99)) for _ in range(rng.choice([0, 2, 300]))] for i in range(90)}
    (tmp_path / "images.bin").write_bytes(whole([image(i, seen[i]) for i in range(90)]))
    rows = {r.image_id: r for r in scenes.read_poses_binary(spark, f"{tmp_path}/images.bin", every=11).collect()}
    assert len(rows) == 90
    for i, r in rows.items():
        assert r.name == "é" * (i % 5) + f"{i}.png" and (r.camera_id, list(r.qvec), list(r.tvec)) == (i % 3, [1.0, 0.0, 0.0, i / 8], [i, 2.0, 3.0])
        assert [tuple(o) for o in r.obs] == seen[i]
