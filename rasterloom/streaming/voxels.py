"""Voxel sampling of a stream: the chosen point of every voxel is state that outlives micro-batches.

Sampling each micro-batch on its own keeps one point per voxel and batch. Here a
voxel met again later keeps its one point: the lowest class id, then the first in
file order, whatever the order of arrival. So after any number of batches and
restarts the result is that of the batch operator over everything seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# Voxels per axis of a block. A block is one state value, read and written once a
# micro-batch; it holds at most BLOCK^3 points however many arrive.
BLOCK = 16
_AXES = ("x", "y", "z")
_KEY = ["_bx", "_by", "_bz"]
_POINT = ["slot", "class_id", "src_file", "point_idx", "x", "y", "z"]
_ORDER = ["slot", "class_id", "src_file", "point_idx"]
_POINT_TYPES = "slot int, class_id int, src_file string, point_idx long, x double, y double, z double"
_STATE = (
    "slot array<int>, class_id array<int>, src_file array<string>, point_idx array<long>, "
    "x array<double>, y array<double>, z array<double>"
)
_OUT = f"_bx long, _by long, _bz long, {_POINT_TYPES}"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _best(points: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """The first point of every voxel; of one point met twice the one with the smaller ``_new``."""
    order = [*by, *_ORDER, *(["_new"] if "_new" in points else [])]
    return points.sort_values(order, kind="stable").drop_duplicates([*by, "slot"])


def _first_of_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Combines before the shuffle: one point per voxel and Arrow batch."""
    for frame in frames:
        yield _best(frame, _KEY)


class VoxelState(StatefulProcessor):
    """Keeps the chosen points of one block of voxels and tells those that changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("best", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({c: [] for c in _POINT})
        if self._state.exists():
            best = pd.DataFrame(dict(zip(_POINT, self._state.get())))
        best["_new"] = 0
        for frame in rows:
            arrived = frame[_POINT].assign(_new=1)
            best = _best(pd.concat([best, arrived]) if len(best) else arrived, [])
        changed = best[best["_new"] == 1]
        if len(changed):
            self._state.update(tuple(best[c].tolist() for c in _POINT))
            yield changed[_POINT].assign(**dict(zip(_KEY, key)))[[*_KEY, *_POINT]]

    def close(self) -> None:
        pass


def voxel_changes(stream: DataFrame, size: float) -> DataFrame:
    """Points that became their voxel's choice in a micro-batch: src_file, point_idx, x, y, z, class and the voxel."""
    if size <= 0:
        raise ValueError("a voxel needs a positive size")
    cell = {a: F.floor(F.col(a) / F.lit(float(size))).cast("long") for a in _AXES}
    block = [F.floor(cell[a] / BLOCK).cast("long").alias(k) for a, k in zip(_AXES, _KEY)]
    inside = [F.pmod(cell[a], F.lit(BLOCK)) for a in _AXES]
    slot = (inside[0] * BLOCK + inside[1]) * BLOCK + inside[2]
    points = stream.select(
        *block,
        slot.cast("int").alias("slot"),
        F.col("class").cast("int").alias("class_id"),
        "src_file",
        F.col("point_idx").cast("long").alias("point_idx"),
        *[F.col(a).cast("double").alias(a) for a in _AXES],
    )
    combined = points.mapInPandas(_first_of_batch, _OUT)
    chosen = combined.groupBy(*_KEY).transformWithStateInPandas(VoxelState(), _OUT, "Update", "None")
    whole = [
        (F.col(k) * BLOCK + F.floor(F.col("slot") / F.lit(BLOCK**n)) % BLOCK).cast("long").alias(f"v{a}")
        for a, k, n in zip(_AXES, _KEY, (2, 1, 0))
    ]
    return chosen.select("src_file", "point_idx", *_AXES, F.col("class_id").alias("class"), *whole)


def start_voxel_ingest(
    stream: DataFrame, size: float, target: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Stores the changes of each micro-batch below ``target``.

    A batch has a folder of its own that a retried batch overwrites, and state is
    committed with the batch, so a restart neither repeats nor loses a change.
    The state store is set for this query alone: the session's setting is put back.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        writer = voxel_changes(stream, size).writeStream.outputMode("update").foreachBatch(write)
        writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def current_voxels(spark: SparkSession, target: str) -> DataFrame:
    """The chosen points after the last stored batch: each voxel's latest change."""
    changes = spark.read.parquet(target)
    point = ["src_file", "point_idx", *_AXES, "class"]
    latest = changes.groupBy(*[f"v{a}" for a in _AXES]).agg(F.max_by(F.struct(*point), "batch").alias("_point"))
    return latest.select("_point.*")
