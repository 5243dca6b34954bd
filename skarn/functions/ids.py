"""Image-pair ids, canonical order of matches, unsigned casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import MAX_ID


def _long(x: Column | str | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x).cast("long")


def pair_id(a: Column | str | int, b: Column | str | int) -> Column:
    """One number for a pair of ids in whatever order, another one for each pair of ids that are at most MAX_ID apart."""
    a, b = _long(a), _long(b)
    return F.least(a, b) * F.lit(MAX_ID).cast("long") + F.greatest(a, b)


def first_of(pair: str) -> Column:
    """The smaller id, by whole-number division: ``/`` would go by way of doubles and lose the lowest digits.

    A pair's number is the smaller id MAX_ID + 1 times and the distance of the two, so ids of MAX_ID and more, which images
    don't have, come back too.
    """
    return F.expr(f"{pair} div {MAX_ID + 1}L")


def second_of(pair: str) -> Column:
    return F.expr(f"{pair} - {pair} div {MAX_ID + 1}L * {MAX_ID}L")


def pairs_with_first(k: int, pair: str = "pair_id") -> Column:
    """Pairs whose smaller id is ``k``, as a range that a Parquet scan can use, which a formula of the column can't be."""
    return F.col(pair).between(k * MAX_ID, k * MAX_ID + MAX_ID - 1)


def valid_image_id(x: Column | str) -> Column:
    return _long(x).between(0, MAX_ID - 1)


def swapped(matches: Column | str) -> Column:
    """Each match's two indices, the other way round."""
    return F.transform(matches, lambda m: F.struct(m["idx2"].alias("idx1"), m["idx1"].alias("idx2")))


def canonical(a: Column | str, b: Column | str, matches: Column | str) -> Column:
    """Matches in the order (smaller id, greater id)."""
    matches = F.col(matches) if isinstance(matches, str) else matches
    return F.when(_long(a) > _long(b), swapped(matches)).otherwise(matches)


def _wrapped(x: Column, size: int) -> Column:
    return F.pmod(x.cast("bigint"), F.lit(size).cast("bigint"))


def uint8(x: Column) -> Column:
    """Truncated towards zero, then modulo 256."""
    return _wrapped(x, 1 << 8).cast("smallint")


def uint32(x: Column) -> Column:
    """Truncated towards zero, then modulo 2 ** 32."""
    return _wrapped(x, 1 << 32)
