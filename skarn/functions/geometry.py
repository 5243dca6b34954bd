"""Poses, axes, rays and frustums as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x, y, z), XYZ, strict=True)))


def camera_center(rotation: Column, translation: Column) -> Column:
    """Where a camera stands, from camera-from-world rotation (9, by rows) and translation (3): -R'T."""
    parts = [-(rotation[i] * translation[0] + rotation[3 + i] * translation[1] + rotation[6 + i] * translation[2]) for i in range(3)]
    return point(*parts)


def camera_axes(rotation: Column) -> list[Column]:
    """The rotation's rows."""
    return [point(*(rotation[3 * i + j] for j in range(3))) for i in range(3)]


def along(origin: Column, direction: Column, scale: Column | float = 1.0) -> Column:
    """origin + scale * direction."""
    scale = F.lit(float(scale)) if isinstance(scale, int | float) else scale
    return point(*(origin[n] + scale * direction[n] for n in XYZ))


def unit(p: Column, origin: Column) -> Column:
    """Direction from ``origin`` to ``p`` of length 1; null parts where they coincide."""
    d = [p[n] - origin[n] for n in XYZ]
    size = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return point(*(F.try_divide(x, size) for x in d))


def rotation_from_quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Rows of the rotation of a quaternion of any length but 0."""
    n = w * w + x * x + y * y + z * z
    parts = (n - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), n - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), n - 2 * (x * x + y * y))
    return F.array(*(F.try_divide(p.cast("double"), n.cast("double")) for p in parts))


def segments(parts: Sequence[tuple[Column, Column, Column]]) -> Column:
    """array<struct<name, from, to>> of (name, from, to)."""
    return F.array(*(F.struct(n.alias("name"), a.alias("from"), b.alias("to")) for n, a, b in parts))
