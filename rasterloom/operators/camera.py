"""Cameras: resolving poses, selecting, splitting, and projecting points into them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rasterloom.functions.geometry import ROTATION, camera_center, quat_to_rot, to_camera
from rasterloom.functions.paths import stem
from rasterloom.operators.joins import fits_broadcast, salted_join
from rasterloom.operators.ranking import numbered
from rasterloom.operators.raster_hits import nearest_per_pixel
from rasterloom.session import cut_lineage

CAMERA_COLUMNS = ("image", "width", "height", "fx", "fy", "cx", "cy", *ROTATION, "t0", "t1", "t2")

# Cells along the widest side of the middle of a cloud, and the fewest cells in a block.
_GRID = 16
# Pairs of (cell, camera) that are broadcast; past this the points are shuffled to them.
_BROADCAST_PAIRS = 500_000


def resolve_cameras(
    images: DataFrame,
    intrinsics: DataFrame,
    target_width: int | None = None,
    target_height: int | None = None,
) -> DataFrame:
    """Join poses to intrinsics and flatten them; pinhole models only.

    With a target size the focal lengths and centre scale with the image.
    """
    keys = [k for k in ("scene", "camera_id") if k in images.columns and k in intrinsics.columns]
    model, params = F.col("model"), F.col("params")
    unsupported = F.raise_error(F.concat(F.lit("unsupported camera model: "), model)).cast("double")

    def param(pinhole: int, simple: int) -> Column:
        return (
            F.when(model == "PINHOLE", F.element_at(params, pinhole + 1))
            .when(model == "SIMPLE_PINHOLE", F.element_at(params, simple + 1))
            .otherwise(unsupported)
        )

    rescale = target_width is not None and target_height is not None
    sx = F.lit(float(target_width)) / F.col("width") if rescale else F.lit(1.0)
    sy = F.lit(float(target_height)) / F.col("height") if rescale else F.lit(1.0)
    quat = [F.element_at("qvec", i + 1) for i in range(4)]
    joined = images.join(intrinsics, keys)
    extra = ["scene"] if "scene" in keys else []
    return joined.select(
        *extra,
        F.col("name").alias("image"),
        (F.lit(int(target_width)) if rescale else F.col("width").cast("int")).alias("width"),
        (F.lit(int(target_height)) if rescale else F.col("height").cast("int")).alias("height"),
        (param(0, 0) * sx).alias("fx"),
        (param(1, 0) * sy).alias("fy"),
        (param(2, 1) * sx).alias("cx"),
        (param(3, 2) * sy).alias("cy"),
        *[c.alias(k) for k, c in quat_to_rot(*quat).items()],
        *[F.element_at("tvec", i + 1).alias(f"t{i}") for i in range(3)],
    )


def with_center(cameras: DataFrame) -> DataFrame:
    return cameras.withColumns(camera_center())


def find_camera(cameras: DataFrame, wanted: DataFrame) -> DataFrame:
    """One camera per wanted ``name``: by full name, else by stem; a miss raises.

    ``wanted`` has one column ``name``. Among cameras sharing a stem the first by
    name is taken.
    """
    exact = wanted.join(cameras.withColumn("_hit", F.lit(True)), wanted["name"] == cameras["image"], "left")
    by_stem = (
        cameras.withColumn("_stem", stem(F.col("image")))
        .groupBy("_stem")
        .agg(F.min_by(F.struct(*cameras.columns), "image").alias("_camera"))
    )
    chosen = (
        exact.select("name", "_hit", F.struct(*cameras.columns).alias("_exact"))
        .withColumn("_stem", stem(F.col("name")))
        .join(by_stem, "_stem", "left")
        .withColumn("_pick", F.when(F.col("_hit"), F.col("_exact")).otherwise(F.col("_camera")))
    )
    missing = F.raise_error(F.concat(F.lit("camera not found: "), F.col("name")))
    return chosen.select(
        F.when(F.col("_pick").isNotNull(), F.col("name")).otherwise(missing).alias("name"), "_pick.*"
    )


def holdout_split(cameras: DataFrame, every: int = 8, name: str = "image") -> DataFrame:
    """Number cameras by name and mark every ``every``-th one as test."""
    return numbered(cameras, [name]).withColumn("is_test", F.col("position") % F.lit(every) == 0)


def camera_extent(cameras: DataFrame, margin: float = 1.1) -> DataFrame:
    """Mean camera centre and ``margin`` times the largest distance from it, one row."""
    centers = with_center(cameras)
    names = ("center_x", "center_y", "center_z")
    mean = centers.agg(F.struct(*[F.avg(n).alias(n) for n in names]).alias("m")).select("m").scalar()
    placed = centers.withColumn("_m", mean)
    gaps = [F.col(n) - F.col("_m")[n] for n in names]
    distance = F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])
    return placed.agg(
        *[F.first(F.col("_m")[n]).alias(n) for n in names],
        (F.max(distance) * F.lit(margin)).alias("radius"),
    )


def camera_list(train: DataFrame, test: DataFrame, name: str = "image") -> DataFrame:
    """Test cameras, then train cameras, with a running id."""
    both = test.withColumn("_role", F.lit(0)).unionByName(train.withColumn("_role", F.lit(1)))
    return numbered(both, ["_role", name], "id").drop("_role")


def shuffled(cameras: DataFrame, seed: int, name: str = "image") -> DataFrame:
    """Cameras in a reproducible random order."""
    return cameras.orderBy(F.xxhash64(F.lit(int(seed)), F.col(name)), name)


def _to_pixels(pairs: DataFrame, min_depth: float, max_depth: float) -> DataFrame:
    """Depth test, projection with truncation toward zero, then image bounds."""
    xc, yc, zc = to_camera(F.col("x"), F.col("y"), F.col("z"))
    depth = F.col("_zc")
    seen = (
        pairs.withColumns({"_xc": xc, "_yc": yc, "_zc": zc})
        .filter((depth > F.lit(float(min_depth))) & (depth < F.lit(float(max_depth))))
        .withColumns(
            {
                "_u": (F.col("fx") * F.col("_xc") / depth + F.col("cx")).try_cast("int"),
                "_v": (F.col("fy") * F.col("_yc") / depth + F.col("cy")).try_cast("int"),
            }
        )
    )
    inside = (
        (F.col("_u") >= 0) & (F.col("_u") < F.col("width")) & (F.col("_v") >= 0) & (F.col("_v") < F.col("height"))
    )
    return seen.filter(inside)


def _middle_sides(points: DataFrame) -> tuple[float, list[tuple[float, float]]]:
    """The widest side of the middle 98 % of the cloud, and each axis' lowest and highest finite coordinate; one job."""

    def finite(axis: str) -> Column:
        value = F.col(axis).cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)

    shares = F.array(F.lit(0.01), F.lit(0.99))
    parts = [f(finite(a)) for a in "xyz" for f in (lambda c: F.percentile_approx(c, shares, F.lit(1000)), F.min, F.max)]
    row = points.agg(*parts).first()
    side = max((r[1] - r[0] for r in row[::3] if r), default=0.0)
    return side, [(0.0, 0.0) if row[i] is None else (row[i], row[i + 1]) for i in (1, 4, 7)]


def _edge_of(side: float) -> float:
    return 2.0 ** math.floor(math.log2(side / _GRID)) if side > 0 else 1.0


def cell_edge(points: DataFrame) -> float:
    """Edge of the cells that points are matched to cameras by: a power of two.

    It follows the middle 98 % of the coordinates, so a few far points do not
    change it, and is about a sixteenth of their widest side.
    """
    return _edge_of(_middle_sides(points)[0])


def _box_test(axes: Sequence[str], edge: float) -> Column:
    """Whether the box of cells (numbers in ``axes``, side ``edge``) may hold a visible point.

    A test's largest value over a box is the value at the box centre plus the
    absolute coefficients times the half edges. A box failing one test holds no
    visible point; a small slack covers rounding.
    """

    def passes(plane: Column) -> Column:
        value = plane["d"] + plane["slack"]
        for i, axis in enumerate(axes):
            middle = (F.col(axis) + F.lit(0.5)) * F.lit(edge)
            half = F.lit(edge * 0.5000001) + F.abs(middle) * F.lit(1e-12)
            value = value + plane[f"n{i}"] * middle + F.abs(plane[f"n{i}"]) * half
        return value > 0

    return F.forall("_planes", passes)


_PLANE = ("n0", "n1", "n2", "d", "slack")
_PLANES = "_planes array<struct<n0: double, n1: double, n2: double, d: double, slack: double>>"
# Cameras whose blocks are listed at once in a task.
_LISTED = 64


def _camera_planes(c: dict[str, np.ndarray], min_depth: float, max_depth: float) -> np.ndarray:
    """The six linear tests that a visible point passes, n . point + d > 0: camera x plane x (n, d, slack)."""

    def plane(a: np.ndarray | float, row: int, b: np.ndarray | float, shift: float = 0.0) -> list[np.ndarray]:
        """a * (camera axis ``row``) + b * depth + shift."""
        normal = [a * c[f"r{row}{i}"] + b * c[f"r2{i}"] for i in range(3)]
        return [*normal, a * c[f"t{row}"] + b * c["t2"] + shift, 1e-9 * (np.abs(a) + np.abs(b)) + 0 * c["t2"]]

    planes = [
        plane(0.0, 0, 1.0, -min_depth),
        plane(0.0, 0, -1.0, max_depth),
        plane(c["fx"], 0, c["cx"] + 1),
        plane(-c["fx"], 0, c["width"] - c["cx"]),
        plane(c["fy"], 1, c["cy"] + 1),
        plane(-c["fy"], 1, c["height"] - c["cy"]),
    ]
    return np.stack([np.stack(p, axis=-1) for p in planes], axis=1)


def _camera_boxes(c: dict[str, np.ndarray], max_depth: float) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest coordinates of each camera's centre and its four far corners."""
    axes = np.stack([np.stack([c[f"r{row}{i}"] for i in range(3)], axis=-1) for row in range(3)], axis=1)
    shift = np.stack([c[f"t{row}"] for row in range(3)], axis=-1)
    center = -np.einsum("nri,nr->ni", axes, shift)
    corners = [center]
    for u in (-1.0, c["width"]):
        for v in (-1.0, c["height"]):
            ray = np.stack([(u - c["cx"]) / c["fx"], (v - c["cy"]) / c["fy"], np.ones(len(center))], axis=-1)
            corners.append(center + np.einsum("nri,nr->ni", axes, ray) * max_depth)
    return np.min(corners, axis=0), np.max(corners, axis=0)


def frustum_blocks(
    cameras: DataFrame, edge: float, min_depth: float, max_depth: float, bounds: Sequence[tuple[float, float]]
) -> DataFrame:
    """Cameras with their ``_planes`` and the blocks (``_bx``, ``_by``, ``_bz``) of side ``edge`` their frustum may touch.

    Blocks come from the box around the camera's centre and its four far corners,
    cut to the ``bounds`` of the cloud. A camera with a parameter that is not a number sees nothing.
    The lists are made in numpy: as column expressions they grew beyond what Catalyst and the JVM handle well.
    """
    names = [n for n in CAMERA_COLUMNS if n != "image"]
    schema = T.StructType([*cameras.schema, *T.StructType.fromDDL(f"{_PLANES}, _bx double, _by double, _bz double")])
    arrow = to_arrow_schema(schema)
    low, high = (np.array([math.floor(b[k] / edge) for b in bounds], np.float64) for k in (0, 1))

    def listed(piece: pa.RecordBatch) -> pa.RecordBatch:
        c = {n: piece.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names}
        with np.errstate(all="ignore"):
            planes = _camera_planes(c, min_depth, max_depth)
            first, last = _camera_boxes(c, max_depth)
            first, last = (np.floor((box + way * edge * 1e-6) / edge) for box, way in ((first, -1), (last, 1)))
        # a far corner that is nowhere leaves the cloud's bounds
        first = np.clip(np.where(np.isnan(first), low, first), low, high + 1)
        last = np.clip(np.where(np.isnan(last), high, last), low - 1, high)
        sides = np.maximum(last - first + 1, 0).astype(np.int64)
        sides[~np.isfinite(planes).all(axis=(1, 2))] = 0
        counts = sides.prod(axis=1)
        at = np.repeat(np.arange(len(counts)), counts)
        step = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        block = np.empty((len(at), 3))
        for axis in (2, 1, 0):
            step, inside = np.divmod(step, sides[at, axis])
            block[:, axis] = first[at, axis] + inside
        middle = (block + 0.5) * edge
        half = edge * 0.5000001 + np.abs(middle) * 1e-12
        touched = np.ones(len(at), bool)
        for k in range(planes.shape[1]):
            plane = planes[at, k]
            value = plane[:, 3] + plane[:, 4] + (plane[:, :3] * middle).sum(1) + (np.abs(plane[:, :3]) * half).sum(1)
            touched &= value > 0
        at, block = at[touched], block[touched]
        flat = planes[at].reshape(-1, len(_PLANE))
        structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(len(_PLANE))], names=list(_PLANE))
        offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * planes.shape[1])
        columns = [c.take(pa.array(at)) for c in piece.columns]
        columns += [pa.ListArray.from_arrays(offsets, structs), *[pa.array(block[:, i]) for i in range(3)]]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _LISTED):
                yield listed(batch.slice(start, _LISTED))

    return cameras.mapInArrow(run, schema)


def visible_cells(
    cells: DataFrame,
    cameras: DataFrame,
    edge: float,
    min_depth: float,
    max_depth: float,
    bounds: Sequence[tuple[float, float]] | None = None,
) -> DataFrame:
    """(cell, camera) pairs whose cell may hold a visible point, for the cells that hold points.

    Cells have a fixed size wherever they lie. They are found through blocks of
    at least sixteen cells and an eighth of the largest depth a side, so a camera
    lists a bounded number of blocks (about 17 x 17 x 17 in a box around its
    frustum, for usual opening angles) however wide the scene is, and only those
    within the cloud's ``bounds``; those of the cells where none are given.
    """
    if bounds is None:
        row = cells.agg(*[f(f"_c{a}") for a in "xyz" for f in (F.min, F.max)]).first()
        bounds = [((row[2 * i] or 0.0) * edge, (row[2 * i + 1] or 0.0) * edge) for i in range(3)]
    times = max(_GRID, math.ceil(max_depth / 8.0 / edge))
    blocks = frustum_blocks(cameras, edge * times, min_depth, max_depth, bounds)
    held = cells.withColumns({f"_b{a}": F.floor(F.col(f"_c{a}") / F.lit(times)).cast("double") for a in "xyz"})
    met = salted_join(held, blocks, ["_bx", "_by", "_bz"], salts=4)
    return met.filter(_box_test(("_cx", "_cy", "_cz"), edge)).select(
        "_cx", "_cy", "_cz", *cameras.columns
    )


def project_points(
    points: DataFrame, cameras: DataFrame, min_depth: float = 0.01, max_depth: float = 100.0
) -> DataFrame:
    """Every point in every camera that sees it: image, y, x, depth, class, point order.

    Points are put into cells of a fixed size, occupied cells are matched with
    the camera frusta, and points meet only the cameras that can see their cell
    (an equi-join), so the work follows what is visible and not points times
    cameras. The pairs are stored, and broadcast when few; otherwise points are
    spread over salted cells.
    """
    camera = cameras.select(*CAMERA_COLUMNS)
    side, bounds = _middle_sides(points)
    edge = _edge_of(side)
    placed = points.withColumns({f"_c{a}": F.floor(F.col(a).cast("double") / F.lit(edge)).cast("double") for a in "xyz"})
    # a coordinate that is not a number is in no cell; cells are doubles, so none overflows
    placed = placed.filter(~F.isnan(F.col("_cx") + F.col("_cy") + F.col("_cz")))
    on = ["_cx", "_cy", "_cz"]
    pairs = visible_cells(placed.select(*on).distinct(), camera, edge, min_depth, max_depth, bounds)
    pairs = cut_lineage(pairs)
    if fits_broadcast(pairs, _BROADCAST_PAIRS):
        met = placed.join(F.broadcast(pairs), on)
    else:
        met = salted_join(placed, pairs, on)
    return _to_pixels(met, min_depth, max_depth).select(
        "image",
        F.col("_v").alias("y"),
        F.col("_u").alias("x"),
        F.col("_zc").cast("float").alias("depth"),
        F.col("class").alias("label"),
        "src_file",
        "point_idx",
    )


def zbuffer(hits: DataFrame) -> DataFrame:
    """Nearest hit per pixel (single precision), the first point on a tie.

    Hits are reduced to one per pixel in each task before the shuffle, and per tile after it.
    """
    return nearest_per_pixel(hits)


def coverage(pixels: DataFrame, cameras: DataFrame, name: str = "coverage") -> DataFrame:
    """Share of each image's pixels that carry a label; images with none count as 0."""
    covered = pixels.groupBy("image").agg(F.count("label").alias("covered"))
    return cameras.select("image", "width", "height").join(covered, "image", "left").select(
        "image",
        F.coalesce("covered", F.lit(0)).alias("covered"),
        (
            F.coalesce("covered", F.lit(0)) / (F.col("width").cast("double") * F.col("height"))
        ).alias(name),
    )
