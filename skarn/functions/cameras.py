"""Camera models: focal length and parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model numbers, and the focal length that is assumed where none is known, in longer sides.
MODELS = {"simple-pinhole": 0, "pinhole": 1, "simple-radial": 2, "opencv": 4}
DEFAULT_FOCAL, FILM_MM, RADIAL = 1.2, 35.0, 0.1


def focal(width: Column, height: Column, film_focal: Column, strict: bool = False) -> Column:
    """Focal length in pixels from its 35 mm equivalent (0 gives 0), else 1.2 longer sides; ``strict`` raises instead."""
    longer = F.greatest(width, height)
    fallback = F.raise_error(F.lit("no focal length is known")).cast("double") if strict else F.lit(DEFAULT_FOCAL) * longer
    return F.when(film_focal.isNotNull(), film_focal / F.lit(FILM_MM) * longer).otherwise(fallback)


def focal_source(film_focal: Column) -> Column:
    return F.when(film_focal.isNotNull(), "exif").otherwise("default")


def params(model: Column, f: Column, width: Column, height: Column) -> Column:
    """Parameters by model number; another model raises."""
    f, x, y = f.cast("double"), width / F.lit(2.0), height / F.lit(2.0)
    zero = F.lit(0.0)
    return (
        F.when(model == MODELS["simple-pinhole"], F.array(f, x, y))
        .when(model == MODELS["pinhole"], F.array(f, f, x, y))
        .when(model == MODELS["simple-radial"], F.array(f, x, y, F.lit(RADIAL)))
        .when(model == MODELS["opencv"], F.array(f, f, x, y, zero, zero, zero, zero))
        .otherwise(F.raise_error(F.concat(F.lit("unknown camera model "), F.coalesce(model.cast("string"), F.lit("null")))).cast("array<double>"))
    )
