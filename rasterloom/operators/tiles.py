"""Square tiles with a halo: one shuffle, after which neighbourhood work is local.

Each pixel goes to its own tile and to every tile whose halo it lies in. Rows are
hash-partitioned by (image, tile), so windows and group-bys whose keys contain
those columns need no further exchange, and no task holds more than a tile's
worth of pixels at a time however large or popular an image is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rasterloom.functions.vectors import argmax
from rasterloom.operators.joins import lookup_join
from rasterloom.session import cut_lineage, spread

TILE = 256
TILE_KEY = ("image", "_ty", "_tx")


def tile_for(halo: Column, tile: int = TILE) -> Column:
    """Tile size for a halo that differs by row: never below twice the halo, so a row has at most four copies."""
    return F.greatest(F.lit(int(tile)), 2 * halo)


def to_tiles(pixels: DataFrame, halo: int | Column, tile: int | Column = TILE) -> DataFrame:
    """Copy rows into all tiles that need them and partition by tile."""
    reach = halo if isinstance(halo, Column) else F.lit(int(halo))
    tile = tile if isinstance(tile, Column) else F.lit(int(tile))
    out = pixels
    for axis in ("y", "x"):
        low = F.greatest(F.floor((F.col(axis) - reach) / tile), F.lit(0)).cast("int")
        high = F.floor((F.col(axis) + reach) / tile).cast("int")
        out = out.withColumn(f"_t{axis}", F.explode(F.sequence(low, high)))
    return out.repartition(*TILE_KEY)


def own_tile(tile: int | Column = TILE) -> Column:
    """True for rows inside their tile proper, not in its halo."""
    tile = tile if isinstance(tile, Column) else F.lit(int(tile))
    return (F.floor(F.col("y") / tile) == F.col("_ty")) & (F.floor(F.col("x") / tile) == F.col("_tx"))


def shift_rows(
    rows: DataFrame, offsets: Sequence[tuple[int, ...]], names: Sequence[str] = (), when: Column | None = None
) -> DataFrame:
    """Emit each row once per offset (dy, dx, *extra), moved to y + dy, x + dx.

    Further entries of an offset become int columns called ``names``. Rows failing
    ``when`` are emitted once, in place, with the extras of the first offset.
    """
    fields = ("_dy", "_dx", *names)
    table = F.array(*[F.struct(*[F.lit(int(v)).alias(f) for f, v in zip(fields, o)]) for o in offsets])
    if when is not None:
        table = F.when(when, table).otherwise(F.slice(table, 1, 1))
    out = rows.withColumn("_o", F.explode(table))
    return out.withColumns(
        {
            "y": F.col("y") + F.col("_o._dy"),
            "x": F.col("x") + F.col("_o._dx"),
            **{n: F.col(f"_o.{n}") for n in names},
        }
    ).drop("_o")


# --- windowed prediction: a model runs on overlapping windows of an image ----------


def window_origins(size: Column, window: int, stride: int) -> Column:
    """Sorted window starts along one axis: every stride, plus one flush with the end."""
    regular = F.sequence(F.lit(0), size - 1, F.lit(int(stride)))
    flush = F.array(F.greatest(size - F.lit(int(window)), F.lit(0)))
    return F.array_sort(F.array_union(regular, flush))


def window_grid(dims: DataFrame, window: int = 800, stride: int = 600) -> DataFrame:
    """All windows of every image as y0, x0, y1, x1 (half-open, cut at the image edge)."""
    h, w = F.col("height").cast("int"), F.col("width").cast("int")
    return (
        dims.withColumn("y0", F.explode(window_origins(h, window, stride)))
        .withColumn("x0", F.explode(window_origins(w, window, stride)))
        .select(
            "image",
            "y0",
            "x0",
            F.least(F.col("y0") + F.lit(int(window)), h).alias("y1"),
            F.least(F.col("x0") + F.lit(int(window)), w).alias("x1"),
        )
    )


def covering_origins(at: Column, size: Column, window: int, stride: int) -> Column:
    """Origins of the windows that cover a position: the regular ones and the flush one."""
    first = F.greatest(F.ceil((at - F.lit(window - 1)) / F.lit(stride)), F.lit(0)).cast("int")
    last = F.floor(at / F.lit(stride)).cast("int")
    steps = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    regular = F.transform(steps, lambda k: k * F.lit(stride))
    flush = F.greatest(size - F.lit(window), F.lit(0))
    return F.when((at >= flush) & (flush % F.lit(stride) != 0), F.array_append(regular, flush)).otherwise(regular)


def cut_windows(pixels: DataFrame, dims: DataFrame, window: int = 800, stride: int = 600) -> DataFrame:
    """Pixels with the origin of every window that covers them.

    A pixel works out its windows from the image size, so nothing is joined by
    range: only the sizes are looked up.
    """
    return _windowed(pixels, dims, window, stride).drop("height", "width")


def _windowed(pixels: DataFrame, dims: DataFrame, window: int, stride: int) -> DataFrame:
    sized = lookup_join(pixels, dims.select("image", "height", "width"), ["image"])
    for axis, size in (("y", "height"), ("x", "width")):
        covering = covering_origins(F.col(axis), F.col(size).cast("int"), window, stride)
        sized = sized.withColumn(f"{axis}0", F.explode(covering))
    return sized


def stitch_windows(scores: DataFrame) -> DataFrame:
    """Mean score per pixel and class over overlapping windows, then the best class.

    The lowest class id wins a tie. Rows are partitioned by pixel once, which
    serves both group-bys. A task holds all sums of its pixels, so the partitions
    stay as many as they are instead of being merged by their compressed size.
    """
    dealt = spread(scores, "image", "y", "x")
    mean = dealt.groupBy("image", "y", "x", "class_id").agg(F.avg("score").alias("score"))
    best = mean.groupBy("image", "y", "x").agg(
        F.max(F.struct("score", (-F.col("class_id")).alias("neg"))).alias("b")
    )
    return best.select(
        "image", "y", "x", (-F.col("b.neg")).alias("label"), F.col("b.score").alias("score")
    )


# A block holds at least so many windows an axis, and spans at least so many pixels.
_BLOCK_WINDOWS, _BLOCK_SPAN = 2, 256


def _origins(size: int, window: int, stride: int) -> np.ndarray:
    """Sorted window starts along one axis, as ``window_origins`` gives them."""
    return np.array(sorted({*range(0, size, stride), max(size - window, 0)}), np.int64)


def _to_blocks(pixels: DataFrame, dims: DataFrame, window: int, stride: int, span: int) -> DataFrame:
    """Pixels with the numbers of the blocks (``_by``, ``_bx``) whose windows cover them: a halo's overlap, not a row a window."""
    sized = lookup_join(pixels, dims.select("image", "height", "width"), ["image"])
    for axis, size in (("y", "height"), ("x", "width")):
        covering = covering_origins(F.col(axis), F.col(size).cast("int"), window, stride)
        blocks = F.array_distinct(F.transform(covering, lambda o: F.floor(o / F.lit(span)).cast("int")))
        sized = sized.withColumn(f"_b{axis}", F.explode(blocks))
    return sized


def _block_scores(
    group: pa.Table, model: Callable[[np.ndarray], np.ndarray], channels: Sequence[str], window: int, stride: int, span: int
):
    """(rows, sums of scores, windows of the block, all windows) of a block's pixels, strip by strip.

    The pixels are laid out once and windows are slices. Sums are held for the
    lines that windows still to come can touch.
    """
    at = {n: group.column(n).to_numpy().astype(np.int64) for n in ("y", "x")}
    block = {n: int(group.column(f"_b{n}")[0].as_py()) for n in "yx"}
    size = {n: int(group.column(s)[0].as_py()) for n, s in (("y", "height"), ("x", "width"))}
    every = {n: _origins(size[n], window, stride) for n in "yx"}
    own = {n: every[n][every[n] // span == block[n]] for n in "yx"}
    start = {n: int(own[n][0]) for n in "yx"}
    shape = [min(int(own[n][-1]) + window, size[n]) - start[n] for n in "yx"]

    def covering(origins: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(origins, place, "right") - np.searchsorted(origins, place - window, "right")

    order = np.lexsort((at["x"], at["y"]))
    y, x = at["y"][order], at["x"][order]
    mine = covering(own["y"], y) * covering(own["x"], x)
    total = covering(every["y"], y) * covering(every["x"], x)
    picture = np.zeros((*shape, len(channels)), np.float32)
    row_at = np.full(shape, -1, np.int64)
    row_at[y - start["y"], x - start["x"]] = np.arange(len(y))
    for i, channel in enumerate(channels):
        picture[y - start["y"], x - start["x"], i] = group.column(channel).to_numpy()[order]
    sums, low = None, 0
    for top, following in zip(own["y"], [*own["y"][1:], size["y"]]):
        high = int(np.searchsorted(y, top + window))
        for left in own["x"]:
            place = tuple(slice(o - start[n], o - start[n] + window) for n, o in (("y", top), ("x", left)))
            scores = np.asarray(model(picture[place].copy()), np.float32)
            rows = row_at[place]
            there = rows >= 0
            if sums is None:
                sums = np.zeros((0, scores.shape[2]), np.float32)
            if low + len(sums) < high:
                sums = np.concatenate([sums, np.zeros((high - low - len(sums), sums.shape[1]), np.float32)])
            sums[rows[there] - low] += scores[there]
        done = int(np.searchsorted(y, following)) - low
        done = len(sums) if top == own["y"][-1] else min(done, len(sums))
        place = slice(low, low + done)
        yield order[place], sums[:done], mine[place], total[place]
        sums, low = sums[done:], low + done


def _score_lists(sums: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(sums).reshape(-1)))


def _predict_blocks(
    pixels: DataFrame,
    dims: DataFrame,
    model: Callable[[np.ndarray], np.ndarray],
    channels: Sequence[str],
    window: int,
    stride: int,
    decide: bool,
) -> DataFrame:
    span = stride * max(_BLOCK_WINDOWS, -(-_BLOCK_SPAN // stride))
    placed = _to_blocks(pixels.select("image", "y", "x", *channels), dims, window, stride, span)
    schema = T.StructType(
        [pixels.schema["image"], *T.StructType.fromDDL("y int, x int, scores array<float>, windows int, label int, score double")]
    )
    arrow = to_arrow_schema(schema)

    def run(group: pa.Table) -> pa.Table:
        parts = []
        for rows, sums, mine, total in _block_scores(group, model, channels, window, stride, span):
            # a pixel all of whose windows lie in this block is finished here
            ready = (mine == total) if decide else np.zeros(len(mine), bool)
            for part, whole in ((~ready, False), (ready, True)):
                n = int(part.sum())
                if not n:
                    continue
                mean = sums[part] / mine[part, None].astype(np.float32)
                nothing = [pa.nulls(n)] * 2
                if whole:
                    exact = sums[part].astype(np.float64) / mine[part, None]
                    values = [pa.nulls(n), pa.array(exact.argmax(axis=1)), pa.array(exact.max(axis=1))]
                else:
                    values = [_score_lists(mean), *nothing]
                at = [group.column(c).take(pa.array(rows[part])) for c in ("image", "y", "x")]
                columns = [*at, values[0], pa.array(mine[part]), *values[1:]]
                parts.append(pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow))
        return pa.concat_tables(parts) if parts else arrow.empty_table()

    return placed.groupBy("image", "_by", "_bx").applyInArrow(run, schema)


def predict_windows(
    pixels: DataFrame,
    dims: DataFrame,
    model: Callable[[np.ndarray], np.ndarray],
    channels: Sequence[str] = ("r", "g", "b"),
    window: int = 800,
    stride: int = 600,
) -> DataFrame:
    """Run ``model`` on every window; it maps (h, w, c) to scores (h, w, classes).

    One group is a block of neighbouring windows, so a pixel is shipped once to
    each block it lies in (1.36 times at 800/600). The model sees the whole
    window, cut only by the image's border; places without a pixel are 0. The
    result has, per pixel and block, the mean ``scores`` array over ``windows`` windows.
    """
    return _predict_blocks(pixels, dims, model, channels, window, stride, False).drop("label", "score")


def stitch_scores(scores: DataFrame) -> DataFrame:
    """Mean of a pixel's score arrays over its windows, then the best class (first on a tie).

    A row may stand for several ``windows``. Arrays are summed in the aggregate,
    so a pixel's rows combine before the shuffle.
    """
    weight = F.col("windows").cast("double") if "windows" in scores.columns else F.lit(1.0)
    mean = scores.groupBy("image", "y", "x").agg(Summarizer.mean(array_to_vector("scores"), weight).alias("_v"))
    return mean.withColumn("_m", vector_to_array("_v")).select(
        "image", "y", "x", argmax(F.col("_m")).alias("label"), F.array_max("_m").alias("score")
    )


def predict_labels(
    pixels: DataFrame,
    dims: DataFrame,
    model: Callable[[np.ndarray], np.ndarray],
    channels: Sequence[str] = ("r", "g", "b"),
    window: int = 800,
    stride: int = 600,
) -> DataFrame:
    """Best class per pixel by its mean score over all windows (``predict_windows``, then ``stitch_scores``).

    Pixels whose windows all lie in one block are decided there; only those on the
    seams between blocks are shuffled again. The model runs once a window: its results are stored.
    """
    rows = cut_lineage(_predict_blocks(pixels, dims, model, channels, window, stride, True))
    seams = stitch_scores(rows.filter(F.col("label").isNull()).select("image", "y", "x", "scores", "windows"))
    whole = rows.filter(F.col("label").isNotNull()).select("image", "y", "x", "label", "score")
    return whole.unionByName(seams.withColumn("label", F.col("label").cast("int")))
