"""Down-sampling of point clouds with exact row counts and no single-task sort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.joins import lookup_join, salted_join

STRATEGIES = ("none", "uniform", "voxel", "class_aware", "voxel+class_aware")

# point_idx must leave room for the class in one long: 2^47 rows of one file.
_IDX_BITS = 47
_CLASS_BITS = 16
_BUCKET_BITS = 16


def random_key(seed: int) -> Column:
    """Reproducible 62-bit random key of a row: the same on every attempt and partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(int(seed)), F.col("src_file"), F.col("point_idx")), 2)


def chunk_number(chunk_rows: int) -> Column:
    """Which fixed-size chunk of its file a row belongs to."""
    return F.floor(F.col("point_idx") / F.lit(int(chunk_rows))).cast("long")


def class_rate(rates: Mapping[int, float], default: float) -> Column:
    """Retention rate of the row's class, clipped to [0, 1]."""

    def clip(rate: float) -> Column:
        return F.lit(min(1.0, max(0.0, float(rate))))

    out = None
    for class_id, rate in rates.items():
        hit = F.col("class") == int(class_id)
        out = F.when(hit, clip(rate)) if out is None else out.when(hit, clip(rate))
    return clip(default) if out is None else out.otherwise(clip(default))


def exact_sample(
    points: DataFrame,
    groups: Sequence[str],
    rate: Column,
    key: Column,
    key_bits: int = 62,
) -> DataFrame:
    """Exactly floor(n * rate) rows of every group: those with the smallest key.

    ``key`` is a non-negative long below 2^key_bits; ties go to (src_file,
    point_idx). A histogram of the key's leading bits finds, per group, the one
    bucket in which the quota ends. Only that bucket's rows are ranked, so a
    group holding most of the table costs counting, not sorting.
    """
    groups = list(groups)
    shift = max(0, key_bits - _BUCKET_BITS)
    # "class" is at most 16 bits wide, so without a scope there are at most 65,536
    # groups and their cut points may be broadcast; scoped groups have no such bound.
    bounded = set(groups) <= {"class"}

    def with_group(df: DataFrame, per_group: DataFrame) -> DataFrame:
        if bounded:
            return df.join(F.broadcast(per_group), groups)
        return salted_join(df, per_group, groups)

    keyed = points.withColumn("_key", key).withColumn("_bucket", F.shiftright("_key", shift))
    if not groups:
        keyed, groups = keyed.withColumn("_all", F.lit(0)), ["_all"]

    histogram = keyed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    in_order = Window.partitionBy(*groups).orderBy("_bucket")
    cut = (
        histogram.withColumns(
            {
                "_before": F.sum("_n").over(in_order) - F.col("_n"),
                "_total": F.sum("_n").over(Window.partitionBy(*groups)),
            }
        )
        .withColumn("_quota", F.floor(F.col("_total") * rate).cast("long"))
        .filter((F.col("_before") < F.col("_quota")))
        .groupBy(*groups)
        .agg(
            F.max("_bucket").alias("_cut"),
            F.max_by(F.col("_quota") - F.col("_before"), "_bucket").alias("_need"),
        )
    )
    near = with_group(keyed, cut).filter(F.col("_bucket") <= F.col("_cut"))
    rank = F.row_number().over(
        Window.partitionBy(*groups).orderBy("_key", "src_file", "point_idx")
    )
    last = (
        near.filter(F.col("_bucket") == F.col("_cut"))
        .select(*groups, "_key", "src_file", "point_idx", "_need")
        .withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_need"))
        .select(
            *groups,
            F.col("_key").alias("_last_key"),
            F.col("src_file").alias("_last_file"),
            F.col("point_idx").alias("_last_idx"),
        )
    )
    inside = F.struct("_key", "src_file", "point_idx") <= F.struct("_last_key", "_last_file", "_last_idx")
    return with_group(keyed, last).filter(inside).select(*points.columns)


def class_aware_sample(
    points: DataFrame,
    rates: Mapping[int, float],
    default_rate: float = 0.1,
    *,
    seed: int | None = None,
    key: Column | None = None,
    key_bits: int = 62,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Exactly floor(n * rate) random rows per class (and per ``scope`` group)."""
    if key is None:
        if seed is None:
            raise ValueError("sampling needs a seed or a key")
        key, key_bits = random_key(seed), 62
    return exact_sample(points, [*scope, "class"], class_rate(rates, default_rate), key, key_bits)


def uniform_sample(
    points: DataFrame,
    ratio: float,
    *,
    seed: int | None = None,
    key: Column | None = None,
    key_bits: int = 62,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Exactly floor(n * ratio) random rows of the cloud (or of every ``scope`` group)."""
    if key is None:
        if seed is None:
            raise ValueError("sampling needs a seed or a key")
        key, key_bits = random_key(seed), 62
    return exact_sample(points, scope, F.lit(min(1.0, max(0.0, float(ratio)))), key, key_bits)


def voxel_downsample(
    points: DataFrame, size: float, scope: Sequence[str] = (), prefer: str = "lowest_id"
) -> DataFrame:
    """One point per cube of edge ``size``: lowest class id, then first in file order.

    ``prefer="rare"`` ranks classes by how few points they have instead. First
    the best point per voxel and file is found with fixed-width aggregates only
    (hash aggregation, combined before the shuffle); files meet after that.
    """
    if size <= 0:
        return points
    if prefer not in ("lowest_id", "rare"):
        raise ValueError(f"unknown preference {prefer!r}")
    cell = {f"_v{a}": F.floor(F.col(a) / F.lit(float(size))).cast("long") for a in "xyz"}
    rank = F.col("class").cast("long")
    source = points
    if prefer == "rare":
        frequency = points.groupBy("class").agg(F.count("*").alias("_n"))
        order = frequency.select(
            "class", (F.row_number().over(Window.orderBy("_n", "class")) - 1).alias("_rank")
        )
        source, rank = lookup_join(points, order, ["class"]), F.col("_rank").cast("long")
    limit = F.lit(1 << _IDX_BITS)
    packed = F.when(
        (F.col("point_idx") < limit) & (F.col("point_idx") >= 0) & (rank >= 0) & (rank < (1 << _CLASS_BITS)),
        F.shiftleft(rank, _IDX_BITS) + F.col("point_idx"),
    ).otherwise(F.raise_error(F.lit("class or point_idx outside the packed key")).cast("long"))
    voxel = [*scope, *cell]
    carried = [c for c in points.columns if c not in ("src_file", *scope)]
    per_file = (
        source.withColumns({**cell, "_order": packed})
        .groupBy("src_file", *[c for c in voxel if c != "src_file"])
        .agg(F.min("_order").alias("_order"), *[F.min_by(c, "_order").alias(c) for c in carried])
    )
    if "src_file" in scope:
        return per_file.select(*points.columns)
    best = per_file.groupBy(*voxel).agg(
        F.min_by(
            F.struct("src_file", *carried),
            F.struct(F.shiftright("_order", _IDX_BITS), "src_file", "_order"),
        ).alias("_best")
    )
    return best.select(*scope, "_best.*").select(*points.columns)


def downsample(
    points: DataFrame,
    strategy: str = "none",
    *,
    voxel_size: float = 0.05,
    ratio: float = 0.2,
    rates: Mapping[int, float] | None = None,
    default_rate: float = 0.1,
    seed: int | None = None,
    key: Column | None = None,
    key_bits: int = 62,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Apply one named strategy. ``scope`` limits it to groups such as file and chunk."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; use one of {STRATEGIES}")
    if strategy == "none":
        return points
    drawn = {"seed": seed, "key": key, "key_bits": key_bits, "scope": scope}
    if strategy == "uniform":
        return uniform_sample(points, ratio, **drawn)
    if strategy.startswith("voxel"):
        points = voxel_downsample(points, voxel_size, scope)
    if strategy.endswith("class_aware"):
        points = class_aware_sample(points, rates or {}, default_rate, **drawn)
    return points
