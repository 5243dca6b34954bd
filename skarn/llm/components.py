"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_key, removed, written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "m")).alias("x")).first()
    return row["n"], row["x"]


def _star(pairs: DataFrame, large: bool, total: int) -> DataFrame:
    """One half round. ``pairs``: (u, v), ``total`` at most. The minimum of a node is a partial aggregate, so a hub's
    neighbours are never gathered, and the few hubs' minima are broadcast to their rows."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    joined = joined_by_key(pairs, least, ["u"], total)
    if large:
        return joined.where("v > u").select("v", "m").where("v <> m").distinct()
    moved = joined.select("v", "m").where("v <> m")
    return moved.unionByName(least.select(F.col("u").alias("v"), "m").where("v <> m")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, m): each node of ``edges`` (a, b: numbers) that isn't the least of its component, and that least one.

    Null ends and self links are ignored; no edges give an empty table. Each round is a written
    table, so a lost executor costs at most that round. Raises if ``most_rounds`` don't suffice
    (the rounds needed grow with the logarithm of the longest path).
    """
    spark = edges.sparkSession
    state = written(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "cc")
    last = _mark(state)
    for _ in range(most_rounds):
        n = last[0]
        if not n:
            return state
        both = state.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(state.select(F.col("m").alias("u"), "v"))
        wide = written(_star(both, True, 2 * n), "cc", rows=n)
        new = written(_star(wide.select(F.col("v").alias("u"), F.col("m").alias("v")), False, n), "cc", rows=n)
        removed(spark, state)
        removed(spark, wide)
        state, now = new, _mark(new)
        if now == last:
            return state
        last = now
    raise RuntimeError(f"components: {most_rounds} rounds did not suffice")
