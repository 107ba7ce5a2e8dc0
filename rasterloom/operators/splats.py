"""Splat tables: activation, covariance and pruning, and alpha blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.geometry import quat_to_rot


def activate(splats: DataFrame) -> DataFrame:
    """Stored values to usable ones: exp of scales, logistic opacity, unit rotation."""
    rot = [F.element_at("rot", i + 1).cast("double") for i in range(4)]
    length = F.sqrt(rot[0] * rot[0] + rot[1] * rot[1] + rot[2] * rot[2] + rot[3] * rot[3])
    return splats.withColumns(
        {
            "scale": F.transform("scale", lambda s: F.exp(s.cast("double"))),
            "opacity": F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("opacity").cast("double"))),
            "rot": F.array(*[r / F.greatest(length, F.lit(1e-12)) for r in rot]),
        }
    )


def covariance(activated: DataFrame, modifier: float = 1.0) -> DataFrame:
    """Upper triangle of R S S R^T as ``cov`` = [xx, xy, xz, yy, yz, zz]."""
    m = quat_to_rot(*[F.element_at("rot", i + 1) for i in range(4)])
    out = activated.withColumns({f"_{k}": v for k, v in m.items()})
    s = [F.element_at("scale", i + 1) * F.lit(float(modifier)) for i in range(3)]

    def entry(i: int, j: int) -> Column:
        parts = [F.col(f"_r{i}{k}") * F.col(f"_r{j}{k}") * s[k] * s[k] for k in range(3)]
        return parts[0] + parts[1] + parts[2]

    upper = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    return out.withColumn("cov", F.array(*[entry(i, j) for i, j in upper])).drop(*[f"_{k}" for k in m])


def prune(activated: DataFrame, min_opacity: float, extent: float | None = None) -> DataFrame:
    """Drop splats that are too transparent or larger than a tenth of the scene."""
    kept = activated.filter(F.col("opacity") >= F.lit(float(min_opacity)))
    if extent is not None:
        kept = kept.filter(F.array_max("scale") <= F.lit(0.1 * float(extent)))
    return kept


def composite_alpha(pixels: DataFrame, background: float = 0.0) -> DataFrame:
    """Blend r, g, b (0..1) over a grey background by their alpha ``a``."""
    rest = F.lit(float(background)) * (F.lit(1.0) - F.col("a"))
    return pixels.withColumns({c: F.col(c) * F.col("a") + rest for c in ("r", "g", "b")})
