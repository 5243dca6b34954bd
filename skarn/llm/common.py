"""Shared helpers: the shared folder, written tables, input checks."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.hadoop import new_path


#: Rows of a small table to one file, and files of one at least.
FILE_ROWS, LEAST_FILES = 100_000, 8


def written(df: DataFrame, name: str, schema: StructType | None = None, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read with its own schema or ``schema``: cuts lineage and survives lost executors.

    ``rows``: about how many there are, if that is known; a small table then doesn't fall into as many files as there are partitions.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df if rows is None else df.coalesce(max(LEAST_FILES, rows // FILE_ROWS))).write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table from ``written`` that no later plan reads."""
    for f in df.inputFiles()[:1]:
        dropped(spark, f.rsplit("/", 1)[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, null texts as empty ones."""
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))


#: A key that more than one in so many rows hold is hot; there can't be more hot keys than this.
HOT_KEYS = 1000


def joined_by_key(rows: DataFrame, keys: DataFrame, on: list[str], total: int | None = None) -> DataFrame:
    """``rows`` joined with ``keys`` (on, n: how many of ``rows`` hold the key, ...); ``total``: the number of rows, if that is known.

    Hot keys, which ``keys`` must have once, are broadcast, ``HOT_KEYS`` rows at most whatever the
    input; only the others' rows are shuffled, so no key fills a task.
    """
    hot = F.col("n") > F.lit(max(1, (rows.count() if total is None else total) // HOT_KEYS))
    few, rest = F.broadcast(keys.where(hot).drop("n")), keys.where(~hot).drop("n")
    cold = rows.join(F.broadcast(keys.where(hot).select(*on)), on, "left_anti")
    return rows.join(few, on).unionByName(cold.join(rest, on))


#: Bytes of text that a task's Python looks at together.
SLICE_BYTES = 1 << 20


def _cuts(column: pa.Array, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of pieces of at most ``rows`` rows and ``size`` bytes; a row longer than that is a piece of its own."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))))
        yield at, end - at
        at = end


def pieces(column: pa.Array, rows: int = 4096, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """A column of strings or bytes in pieces of bounded size."""
    return (column.slice(*cut) for cut in _cuts(column, rows, size))


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, rows: int = 4096, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches in pieces whose strings or bytes in ``column`` are of bounded size."""
    return (batch.slice(*cut) for batch in batches for cut in _cuts(batch.column(column), rows, size))


#: Ranges of ids for each shuffle partition, and in all at most.
RANGES, MOST_RANGES = 4, 4096


def _percentiles(rows: DataFrame, id_col: str) -> list[int]:
    """The ids' percentiles in order; an id that holds several ranges' rows comes again."""
    parts = min(MOST_RANGES, RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sorted(rows.agg(F.percentile_approx(F.col(id_col).cast("long"), [k / parts for k in range(1, parts)], 50 * parts)).first()[0] or [])


def _numbers(own: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, own))), ",").cast("array<bigint>")


def _bucket(id_col: str, bounds: list[int]) -> Column:
    if not bounds:
        return F.when(F.col(id_col).isNotNull(), 0)
    # every so many bounds first, then those from there on
    step = math.isqrt(len(bounds)) + 1
    coarse = F.size(F.filter(_numbers(bounds[::step]), lambda b: b <= F.col(id_col)))
    near = F.size(F.filter(F.slice(_numbers(bounds), F.greatest(coarse - 1, F.lit(0)) * step + 1, step), lambda b: b <= F.col(id_col)))
    return F.when(F.col(id_col).isNotNull(), F.greatest(coarse - 1, F.lit(0)) * step + near)


def id_buckets(rows: DataFrame, id_col: str) -> Column:
    """Number of the range that a row's id (a whole number) lies in, in ascending order; null ids have none.

    The bounds are the ids' percentiles, so that each range has about as many rows, however the ids lie.
    """
    return _bucket(id_col, sorted(set(_percentiles(rows, id_col))))


def split_buckets(rows: DataFrame, id_col: str, salt: Column) -> Column:
    """As ``id_buckets``, but an id that holds several ranges' rows has as many buckets, to which ``salt`` deals its rows; those of greater ids
    in its range come after them."""
    found = _percentiles(rows, id_col)
    times = Counter(found)
    hot = sorted(v for v, n in times.items() if n > 1)
    bucket = _bucket(id_col, sorted(times)).cast("long") * (MOST_RANGES + 1)
    if not hot:
        return bucket
    at = F.array_position(_numbers(hot), F.col(id_col).cast("long"))
    return bucket + F.when(at > 0, F.pmod(salt.cast("long"), F.get(_numbers([times[v] for v in hot]), (at - 1).cast("int")))).otherwise(MOST_RANGES)
