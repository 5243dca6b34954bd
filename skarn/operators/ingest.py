"""Bulk import: cameras from image sizes, names to ids, pairs without duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import cameras, ids
from ..sources import files
from ..sources.schema import MATCH
from .store import SceneStore, none_of
from .tabular import with_ids

def camera_rows(images: DataFrame, model: str = "simple-radial", single: bool = False, strict: bool = False) -> DataFrame:
    """(camera_id, name, model, width, height, params, focal_source) from (name, width, height, film_focal).

    One camera an image, numbered in the order of the names; with ``single`` one for all, from the
    first name's. The model "opencv" needs ``single``.
    """
    if model == "opencv" and not single:
        raise ValueError("the opencv model needs a single camera")
    if model not in cameras.MODELS:
        raise ValueError(f"unknown camera model {model}")
    rows = images.orderBy("name").limit(1) if single else images
    f = cameras.focal(F.col("width"), F.col("height"), F.col("film_focal"), strict)
    number = F.lit(cameras.MODELS[model])
    return rows.select("name", number.alias("model"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), cameras.params(number, f, F.col("width"), F.col("height")).alias("params"), cameras.focal_source(F.col("film_focal")).alias("focal_source"))


#: Names that are sent to all tasks (some 50 bytes each); of more, those that one row in so many has are, and the others are shuffled.
BROADCAST_NAMES, HOT_NAMES = 1_000_000, 1000


def _hot_names(matches: DataFrame) -> DataFrame:
    """(name): those that more than one in ``HOT_NAMES`` rows have in one of the two columns, by a sketch of bounded size for each task. The sketch
    may take others for hot or miss one; where a name is looked up doesn't change what is found."""
    sketch = "approx_top_k({}, %d, %d)" % (2 * HOT_NAMES, 10 * HOT_NAMES)
    found = matches.agg(F.count("*").alias("rows"), *(F.expr(sketch.format(f"name{k}")).alias(f"top{k}") for k in (1, 2)))
    top = found.select("rows", F.explode(F.concat("top1", "top2")).alias("top"))
    return top.where((F.col("top")["count"] > F.greatest(F.lit(1), F.expr(f"rows div {HOT_NAMES}"))) & F.col("top")["item"].isNotNull()).select(F.col("top")["item"].alias("name")).distinct()


def _looked_up(rows: DataFrame, k: int, names: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with image_id1 or 2 (``k``), null where the name is unknown. ``hot``: (__hot, __hot_id), names whose rows find theirs in a broadcast.

    Those rows and those of null names are spread over all partitions of the join that looks the others up, so ``rows`` are read and shuffled once.
    """
    name, number = F.col(f"name{k}"), f"image_id{k}"
    rows = rows.join(F.broadcast(hot), name == F.col("__hot"), "left")
    cold = name.isNotNull() & F.col("__hot").isNull()
    # the second key only spreads rows whose first is null; a task that runs again sends them to the same places
    spread = -1 - F.pmod(F.xxhash64(F.spark_partition_id(), "name1", "name2"), F.lit(1 << 20)).cast("int")
    rows = rows.withColumns({"__key": F.when(cold, name), "__place": F.when(cold, F.length(name.cast("string"))).otherwise(spread)}).drop("__hot")
    own = names.select(F.col("name").alias("__name"), F.length(F.col("name").cast("string")).alias("__length"), F.col("image_id").alias("__id"))
    rows = rows.join(own, (F.col("__key") == F.col("__name")) & (F.col("__place") == F.col("__length")), "left")
    return rows.withColumn(number, F.coalesce("__id", "__hot_id")).drop("__hot_id", "__key", "__place", "__name", "__length", "__id")


def resolved(matches: DataFrame, names: DataFrame) -> DataFrame:
    """``matches`` (name1, name2, ...) with image_id1 and image_id2; an unknown or null name has a null id.

    Up to ``BROADCAST_NAMES`` names are sent to all tasks. Of more, rows that hold nothing but two names are shuffled by each of them, hot names but
    spread. Of rows that hold more the different pairs of names alone are looked up so, and what the matches hold is shuffled once, by both names together.
    """
    own = names.select(F.col("name").alias("__name"), F.col("image_id").alias("__id"))
    if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        for k in (1, 2):
            matches = matches.join(F.broadcast(own), F.col(f"name{k}") == F.col("__name"), "left").withColumnRenamed("__id", f"image_id{k}").drop("__name")
        return matches
    hot = _hot_names(matches).join(own, F.col("name") == F.col("__name"), "left").select(F.col("name").alias("__hot"), F.col("__id").alias("__hot_id"))
    alone = set(matches.columns) == {"name1", "name2"}
    pairs = matches if alone else matches.select("name1", "name2").distinct()
    for k in (1, 2):
        pairs = _looked_up(pairs, k, names, hot)
    if alone:
        return pairs
    found = pairs.select(F.col("name1").alias("__1"), F.col("name2").alias("__2"), "image_id1", "image_id2")
    same = F.col("name1").eqNullSafe(F.col("__1")) & F.col("name2").eqNullSafe(F.col("__2"))
    return matches.join(found, same, "left").drop("__1", "__2")


def unresolved(matches: DataFrame, names: DataFrame) -> DataFrame:
    """(name) that ``names`` lacks."""
    every = matches.select(F.explode(F.array("name1", "name2")).alias("name")).distinct()
    return every.join(names.select("name"), "name", "left_anti")


def ranked_pairs(pairs: DataFrame, order: list[str], a: str = "image_id1", b: str = "image_id2") -> DataFrame:
    """``pairs`` with pair_id and rank: 1 for the first of each unordered pair in ``order``, which is the one that counts."""
    w = Window.partitionBy("pair_id").orderBy(*order)
    return pairs.withColumn("pair_id", ids.pair_id(a, b)).withColumn("rank", F.row_number().over(w))


def first_pairs(pairs: DataFrame, order: list[str], a: str = "image_id1", b: str = "image_id2") -> DataFrame:
    """The first row of each unordered pair: a partial minimum before the shuffle, so that a pair that repeats
    very often costs a row for each task."""
    keyed = pairs.withColumn("pair_id", ids.pair_id(a, b))
    rest = [c for c in pairs.columns if c not in order]
    packed = F.min_by(F.struct(*order, *rest), F.struct(*order))
    return keyed.groupBy("pair_id").agg(packed.alias("r")).select("pair_id", "r.*").select("pair_id", *pairs.columns)


def duplicate_warnings(pairs: DataFrame, a: str = "image_id1", b: str = "image_id2") -> DataFrame:
    """(pair_id, n_dups): pairs that come more than once, and how many are too many."""
    return pairs.groupBy(ids.pair_id(a, b).alias("pair_id")).agg((F.count("*") - 1).alias("n_dups")).where("n_dups > 0")


def progress_total(n: int) -> int:
    """Pairs of ``n`` images."""
    return n * (n - 1) // 2


def check_files(names: DataFrame, listing: DataFrame, root: str = "") -> None:
    """Raise if an image's file isn't in ``listing`` (path). Names are paths below ``root``, or without it the paths' last parts."""
    have = listing.select((files.below(root, F.col("path")) if root else F.element_at(F.split("path", "/"), -1)).alias("name"))
    missing = names.select("name").join(have, "name", "left_anti").orderBy("name").limit(1).collect()
    if missing:
        raise OSError(f"Invalid image path {missing[0][0]}")


def import_scene(spark: SparkSession, root: str, images: DataFrame, keypoints: DataFrame, matches: DataFrame, camera_model: str = "simple-radial", single_camera: bool = False, refuse_existing: bool = False) -> DataFrame:
    """Fill the store at ``root``; returns the pairs that came twice (pair_id, n_dups).

    images: (name, width, height, film_focal); keypoints: (name, kps); matches: (name1, name2,
    matches array<array<int>>). Only images that have keypoints are imported, numbered in the order
    of their names. An unknown name in matches raises KeyError; a name that repeats in ``images``, or has
    keypoints but no row there, raises too. All six tables change together: what raises leaves the store as it was.
    """
    store = SceneStore(spark, root)
    if refuse_existing and store.exists():
        raise FileExistsError(root)
    none_of(images.groupBy("name").count(), F.col("count") > 1, "images: name repeats")
    named = keypoints.join(images, "name", "left")
    none_of(named.select("name", "width"), F.col("width").isNull(), "Invalid image path")
    unknown = unresolved(matches, keypoints.select("name")).first()
    if unknown:
        raise KeyError(unknown["name"])
    none_of(matches, F.exists("matches", lambda m: F.size(m) != 2), "matches: two columns are needed")
    with store.transaction():
        store.create_tables()
        first = store.next_id("cameras")
        own = camera_rows(named.select("name", "width", "height", "film_focal"), camera_model, single_camera)
        store.add_cameras(own.select("name", "model", "width", "height", "params"), order=["name"])
        # cameras and images are numbered in the same order
        new = named.select("name", F.lit(first).cast("long").alias("camera_id")) if single_camera else with_ids(named.select("name"), "camera_id", [F.col("name")], first)
        store.add_images(new)
        numbers = store.table("images").select("name", "image_id")
        store.add_keypoints(named.join(numbers, "name").select("image_id", F.col("kps").alias("data")))
        pairs = resolved(matches, numbers)
        packed = F.transform("matches", lambda m: F.struct(m[0].cast("long").alias("idx1"), m[1].cast("long").alias("idx2"))).cast(ArrayType(MATCH))
        best = first_pairs(pairs.select("name1", "name2", "image_id1", "image_id2", packed.alias("matches")), ["name1", "name2"])
        store.add_matches(best.select("image_id1", "image_id2", "matches"))
    return duplicate_warnings(pairs)
