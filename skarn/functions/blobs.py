"""Numeric arrays as C-order little-endian bytes, for foreign files only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What each stored array is made of.
DTYPES = {"params": "<f8", "keypoints": "<f4", "descriptors": "<u1", "matches": "<u4", "matrix": "<f8"}
_SPARK = {"<f8": "double", "<f4": "float", "<u1": "smallint", "<u4": "bigint"}


def to_blob(values: Column, dtype: str) -> Column:
    """Bytes of an array, nested or flat; null stays null."""

    @F.pandas_udf("binary")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else np.array([list(r) for r in x] if len(x) and isinstance(x[0], np.ndarray | list) else x).astype(dtype).tobytes())

    return pack(values)


def from_blob(blob: Column, dtype: str, cols: int | None = None) -> Column:
    """A flat array of the bytes' values, or rows of ``cols``; bytes that are no whole number of values or rows raise."""
    element = _SPARK[dtype]

    @F.pandas_udf(f"array<array<{element}>>" if cols else f"array<{element}>")
    def unpack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda b: None if b is None else list(np.frombuffer(b, dtype).reshape(-1, cols)) if cols else np.frombuffer(b, dtype))

    return unpack(blob)
