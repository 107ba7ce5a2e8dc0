"""Cleaning of raw clouds: sample, move, reproject, shift into the scene frame."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import crs
from rasterloom.operators import points, sampling


@dataclass(frozen=True)
class IngestConfig:
    """Defaults follow the common case: no sampling, no shift, no reprojection."""

    strategy: str = "none"
    voxel_size: float = 0.05
    ratio: float = 0.2
    rates: Mapping[int, float] = field(default_factory=dict)
    default_rate: float = 0.1
    seed: int = 0
    # None samples the whole cloud; a row count samples each chunk of each file
    chunk_rows: int | None = None
    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)
    source: crs.Projection | None = None
    target: crs.Projection | None = None
    frame_shift: tuple[float, float, float] | None = None


def sample(cloud: DataFrame, config: IngestConfig) -> DataFrame:
    scope: list[str] = []
    if config.chunk_rows:
        cloud = cloud.withColumn("_chunk", sampling.chunk_number(config.chunk_rows))
        scope = ["src_file", "_chunk"]
    kept = sampling.downsample(
        cloud,
        config.strategy,
        voxel_size=config.voxel_size,
        ratio=config.ratio,
        rates=config.rates,
        default_rate=config.default_rate,
        seed=config.seed,
        scope=scope,
    )
    return kept.drop("_chunk")


def place(cloud: DataFrame, config: IngestConfig) -> DataFrame:
    """The row-wise part: shift, reproject, scene frame. Also fits a stream."""
    moved = points.translate(cloud, *config.shift)
    if config.source is not None and config.target is not None:
        moved = crs.reproject_xy(moved, config.source, config.target)
    return points.frame_shift(moved, config.frame_shift)


def ingest(cloud: DataFrame, config: IngestConfig) -> DataFrame:
    """Sampling comes first, so the costly arithmetic sees only the kept points."""
    return place(sample(cloud, config), config)


def ingest_report(cloud: DataFrame, config: IngestConfig) -> DataFrame:
    """Original and kept counts per file and class, per file and overall."""
    return points.retention_stats(cloud, sample(cloud, config))


@dataclass(frozen=True)
class SurveyConfig:
    """Clouds in feet with their own class codes: remap, reproject, scale and shift."""

    source: crs.Projection | None = None
    target: crs.Projection | None = None
    class_map: Mapping[int, int] = field(default_factory=lambda: {2: 12, 3: 2})
    z_unit: float = points.FOOT_TO_METRE
    scale: tuple[float, float, float] = (1.0, 1.0, 1.0)
    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)
    extra_z: float = 0.0


def ingest_survey(cloud: DataFrame, config: SurveyConfig) -> DataFrame:
    if config.source is not None and config.target is not None:
        cloud = crs.reproject_xy(cloud, config.source, config.target)
    moved = points.affine(cloud, config.z_unit, config.scale, config.shift, config.extra_z)
    return points.remap_classes(moved, config.class_map)


def as_output(cloud: DataFrame) -> DataFrame:
    """Single-precision coordinates, as files store them."""
    return cloud.withColumns({a: F.col(a).cast("float") for a in "xyz"})
