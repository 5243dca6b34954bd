"""What a figure of a scene shows, as rows: points, axes, rays, frustums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.options import split_options

# axes' names and colours, default colours, triangles of a frustum's face.
AXES = ("xaxis", "yaxis", "zaxis")
AXIS_COLOURS = ("rgb(255, 0, 0)", "rgb(0, 255, 0)", "rgb(0, 0, 255)")
RAY_COLOUR, FRUSTUM_COLOUR = "rgb(255, 0, 0)", "rgb(255, 0, 255)"
FACES = ((0, 1, 2), (0, 2, 3))


def _segment(p: Column, q: Column) -> list[Column]:
    return [*(p[n].alias(f"{n}0") for n in g.XYZ), *(q[n].alias(f"{n}1") for n in g.XYZ)]


def points(df: DataFrame, xyz: Column, colour: str | None = None) -> DataFrame:
    """(columns of ``df``, x, y, z, color): markers."""
    return df.select("*", *(xyz[n].alias(n) for n in g.XYZ), F.lit(colour).cast("string").alias("color"))


def axes(df: DataFrame, keep: Sequence[str], position: Column, directions: Sequence[Column], scale: float = 1.0, options: Mapping[str, Any] | None = None) -> DataFrame:
    """(keep, axis, color, x0..z1): three segments from ``position``. Options "color" and "name", for all or one
    axis ("xaxis:color"), are heeded; others aren't."""
    own = split_options(options or {}, AXES, merge=True)
    parts = [F.struct(F.lit(own[a].get("name", a)).alias("axis"), F.lit(own[a].get("color", c)).alias("color"), position.alias("p"), g.along(position, d, scale).alias("q")) for a, c, d in zip(AXES, AXIS_COLOURS, directions, strict=True)]
    rows = df.select(*keep, F.explode(F.array(*parts)).alias("s"))
    return rows.select(*keep, "s.axis", "s.color", *_segment(F.col("s.p"), F.col("s.q")))


def pose_axes(df: DataFrame, keep: Sequence[str], rotation: Column, translation: Column, scale: float = 1.0, options: Mapping[str, Any] | None = None) -> DataFrame:
    """A camera's axes where it stands."""
    return axes(df, keep, g.camera_center(rotation, translation), g.camera_axes(rotation), scale, options)


def rays(df: DataFrame, keep: Sequence[str], origin: Column, directions: Column, scale: float = 1.0, colours: Sequence[str] | None = None) -> DataFrame:
    """(keep, pos, rgb, x0..z1): a segment for each of ``directions`` (array of points). Fewer ``colours`` than directions leave the rest out."""
    each = df.select(*keep, origin.alias("__o"), directions.alias("__ds")).select(*keep, "__o", F.posexplode("__ds").alias("pos", "__d"))
    if colours is None:
        rgb: Column = F.lit(RAY_COLOUR)
    else:
        each = each.where(F.col("pos") < len(colours))
        rgb = F.get(F.array(*map(F.lit, colours)).cast("array<string>"), F.col("pos"))
    return each.select(*keep, "pos", rgb.alias("rgb"), *_segment(F.col("__o"), g.along(F.col("__o"), F.col("__d"), scale)))


def rays_to(df: DataFrame, keep: Sequence[str], origin: Column, targets: Column, scale: float = 1.0, colours: Sequence[str] | None = None) -> DataFrame:
    """Rays of one length towards ``targets`` (array of points); null ends where a target is the origin."""
    return rays(df, keep, origin, F.transform(targets, lambda p: g.unit(p, origin)), scale, colours)


def _corners(rect: Column, scale: float | None) -> Column:
    k = F.lit(1.0 if scale is None else float(scale))
    return F.transform(rect, lambda p: g.point(*(p[n] * k for n in g.XYZ)))


def frustum_edges(df: DataFrame, keep: Sequence[str], position: Column, rect: Column, scale: float | None = None, rgb: str = FRUSTUM_COLOUR) -> DataFrame:
    """(keep, edge, rgb, x0..z1): from ``position`` to each corner, scaled about the world's origin."""
    each = df.select(*keep, position.alias("__o"), _corners(rect, scale).alias("__c")).select(*keep, "__o", F.posexplode("__c").alias("edge", "__q"))
    return each.select(*keep, "edge", F.lit(rgb).alias("rgb"), *_segment(F.col("__o"), F.col("__q")))


def frustum_faces(df: DataFrame, keep: Sequence[str], rect: Column, scale: float | None = None, rgb: str = FRUSTUM_COLOUR, opacity: float = 0.5) -> DataFrame:
    """(keep, face, corner, rgb, opacity, x, y, z): the face's two triangles."""
    corners = _corners(rect, scale)
    parts = [F.struct(F.lit(f).alias("face"), F.lit(k).alias("corner"), corners[i].alias("p")) for f, face in enumerate(FACES) for k, i in enumerate(face)]
    each = df.select(*keep, F.explode(F.array(*parts)).alias("s"))
    return each.select(*keep, "s.face", "s.corner", F.lit(rgb).alias("rgb"), F.lit(opacity).alias("opacity"), *(F.col("s.p")[n].alias(n) for n in g.XYZ))
