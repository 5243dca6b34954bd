"""Schemas of the scene store, and the checks that its writes make."""

from __future__ import annotations

from pyspark.sql import types as T

# The greatest image id plus one, keypoint layouts (x, y), (x, y, theta, scale), (x, y, a11, a12, a21, a22).
MAX_ID = 2**31 - 1
KEYPOINT_COLUMNS = (2, 4, 6)

_L, _I, _D, _S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
MATCH = T.StructType([T.StructField("idx1", _L), T.StructField("idx2", _L)])
_PRIORS = [T.StructField(f"prior_{c}", _D) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")]
_PAIR = [T.StructField("pair_id", _L, False), T.StructField("image_id1", _L, False), T.StructField("image_id2", _L, False), T.StructField("matches", T.ArrayType(MATCH))]

TABLES: dict[str, T.StructType] = {
    "cameras": T.StructType([T.StructField("camera_id", _L, False), T.StructField("model", _I, False), T.StructField("width", _I, False), T.StructField("height", _I, False), T.StructField("params", T.ArrayType(_D)), T.StructField("prior_focal_length", _I, False)]),
    "images": T.StructType([T.StructField("image_id", _L, False), T.StructField("name", _S, False), T.StructField("camera_id", _L, False), *_PRIORS]),
    "keypoints": T.StructType([T.StructField("image_id", _L, False), T.StructField("rows", _I, False), T.StructField("cols", _I, False), T.StructField("data", T.ArrayType(T.ArrayType(T.FloatType())))]),
    "descriptors": T.StructType([T.StructField("image_id", _L, False), T.StructField("rows", _I, False), T.StructField("cols", _I, False), T.StructField("data", T.ArrayType(T.ArrayType(T.ShortType())))]),
    "matches": T.StructType(_PAIR),
    "two_view_geometries": T.StructType([*_PAIR, T.StructField("config", _I, False), *(T.StructField(m, T.ArrayType(_D)) for m in "FEH")]),
}
#: Columns that no two rows of a table share.
UNIQUE = {"cameras": ["camera_id"], "images": ["image_id", "name"], "keypoints": ["image_id"], "descriptors": ["image_id"], "matches": ["pair_id"], "two_view_geometries": ["pair_id"]}
#: Column that numbers itself.
NUMBERED = {"cameras": "camera_id", "images": "image_id"}

TRAIN_LABELS = T.StructType([T.StructField(n, _S) for n in ("dataset", "scene", "image", "rotation_matrix", "translation_vector")])
THRESHOLDS = T.StructType([T.StructField(n, _S) for n in ("dataset", "scene", "thresholds")])


def columns(schema: T.StructType) -> list[str]:
    """A catalogue's column names, in order."""
    return schema.fieldNames()


def collect_names(cls: type) -> type:
    """Class decorator: ``cls.names`` lists the values of the class's own ``ClassVar[...]`` attributes, in order.

    A bare ``ClassVar`` without a type is not one of them.
    """
    from typing import ClassVar, get_origin

    cls.names = [cls.__dict__[n] for n, t in cls.__annotations__.items() if get_origin(t) is ClassVar and n in cls.__dict__]
    return cls
