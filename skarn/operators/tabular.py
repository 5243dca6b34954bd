"""Label tables: filters, counts, multimaps, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import hadoop

#: Rows up to which one window numbers a table; more are numbered partition by partition.
ONE_WINDOW_ROWS = 100_000


def where_equal(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows that have ``value``; null never has."""
    return df.where(F.col(column) == value)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def group_count(df: DataFrame, *keys: str) -> DataFrame:
    """Rows for each combination of keys that occurs, without those with a null key, in their order."""
    some = df
    for k in keys:
        some = some.where(F.col(k).isNotNull())
    return some.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys)


def multimap(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values): each key's values in the order of ``order``, which must be told apart by it."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.transform(packed, lambda x: x["v"]).alias("values"))


#: Values of a multimap's row; longer lists go on in further rows.
CHUNK_VALUES = 10_000


def multimap_chunks(df: DataFrame, key: str, value: str, order: list[str], size: int = CHUNK_VALUES) -> DataFrame:
    """(key, chunk, values): each key's values in the order of ``order``, which must tell them apart, in rows of ``size`` values.

    Rows are sorted by ranges of key and order and written, so a key of any size lies in as many ranges as it fills. A value's place is
    its place in its range and the key's values in the ranges before; only keys that go over a range's end have such, so those sums are
    sent to all tasks. A null key is a key like others.
    """
    spark = df.sparkSession
    path = hadoop.new_path(spark, "multimap")
    rows = df.select(F.col(key).alias("k"), F.col(value).alias("v"), F.struct(*order).alias("o"))
    rows.repartitionByRange(F.col("k").asc_nulls_first(), "o").withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranges = spark.read.parquet(path)
    own = ranges.withColumn("place", F.row_number().over(Window.partitionBy("part", "k").orderBy("o")).cast("long") - 1)
    ends = ranges.groupBy("part").agg(F.min(F.struct(F.col("k").isNotNull(), "k")).alias("low"), F.max(F.struct(F.col("k").isNotNull(), "k")).alias("high"))
    ends = ends.select("part", F.explode(F.array_distinct(F.array(F.col("low")["k"], F.col("high")["k"]))).alias("k"))  # two keys of a range may go on
    counts = ranges.join(F.broadcast(ends.withColumnsRenamed({"part": "p", "k": "e"})), (F.col("part") == F.col("p")) & F.col("k").eqNullSafe(F.col("e")), "left_semi").groupBy("part", "k").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.col("part").alias("p"), F.col("k").alias("e"), earlier.alias("before")).where("before > 0")
    placed = own.join(F.broadcast(before), (F.col("part") == F.col("p")) & F.col("k").eqNullSafe(F.col("e")), "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0)))
    packed = F.array_sort(F.collect_list(F.struct("place", "v")))
    found = placed.groupBy(F.col("k").alias(key), F.expr(f"place div {size}").alias("chunk")).agg(F.transform(packed, lambda x: x["v"]).alias("values"))
    return found


def with_ids(df: DataFrame, id_col: str, order: list[Column], first: int = 1, rows: int | None = None) -> DataFrame:
    """``df`` numbered from ``first`` in ``order``.

    A global window is one task; above ``ONE_WINDOW_ROWS`` (``rows``: known, or counted) the table is sorted by
    ranges, written to the checkpoint folder, and each partition numbered from the sum of those before.
    """
    rows = df.count() if rows is None else rows
    if rows <= ONE_WINDOW_ROWS:
        return df.withColumn(id_col, (F.row_number().over(Window.orderBy(*order)) + F.lit(first - 1)).cast("long"))
    hadoop.shared_dir(df.sparkSession)
    placed = df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()).checkpoint()
    part, own = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))  # a row for each partition
    joined = placed.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return joined.withColumn(id_col, (own + F.col("__before") + F.lit(first)).cast("long")).drop("__place", "__part", "__before")
