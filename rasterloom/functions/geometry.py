"""Camera geometry as scalar columns, so that it stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROTATION = ("r00", "r01", "r02", "r10", "r11", "r12", "r20", "r21", "r22")


def quat_to_rot(w: Column, x: Column, y: Column, z: Column) -> dict[str, Column]:
    """The nine entries of the rotation matrix of a unit quaternion (w, x, y, z)."""
    two = F.lit(2.0)

    def diagonal(a: Column, b: Column) -> Column:
        return F.lit(1.0) - two * a * a - two * b * b

    def off(a: Column, b: Column, c: Column, sign: int) -> Column:
        return two * a * b + F.lit(float(sign)) * two * w * c

    return {
        "r00": diagonal(y, z),
        "r01": off(x, y, z, -1),
        "r02": off(x, z, y, 1),
        "r10": off(x, y, z, 1),
        "r11": diagonal(x, z),
        "r12": off(y, z, x, -1),
        "r20": off(x, z, y, -1),
        "r21": off(y, z, x, 1),
        "r22": diagonal(x, y),
    }


def camera_center() -> dict[str, Column]:
    """World position of the camera: minus the transposed rotation times t."""
    out = {}
    for axis, name in enumerate(("center_x", "center_y", "center_z")):
        parts = [F.col(f"r{row}{axis}") * F.col(f"t{row}") for row in range(3)]
        out[name] = -(parts[0] + parts[1] + parts[2])
    return out


def to_camera(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """World point to camera coordinates; rotation and translation are columns of the row."""

    def axis(row: int) -> Column:
        return (
            F.col(f"r{row}0") * x + F.col(f"r{row}1") * y + F.col(f"r{row}2") * z + F.col(f"t{row}")
        )

    return axis(0), axis(1), axis(2)


def fov_to_focal(fov: Column, pixels: Column) -> Column:
    return pixels / (F.lit(2.0) * F.tan(fov / F.lit(2.0)))


def focal_to_fov(focal: Column, pixels: Column) -> Column:
    return F.lit(2.0) * F.atan(pixels / (F.lit(2.0) * focal))
