"""Query catalogue: each operator on the driver's tables, and the DuckDB SQL with the same rows.

The tables stand in for a scene: parts and suppliers for images that lineitems pair, events for
keypoints of their users, embeddings for descriptors, customers for images and labels.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cameras, ids, options
from ..functions import geometry as g
from ..operators import embed, ingest, scene, tabular
from ..operators.store import ConstraintError, SceneStore, valid_layout
from ..sources import files, hadoop
from ..sources.schema import MAX_ID, THRESHOLDS, columns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_M = MAX_ID


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _store(spark: SparkSession) -> SceneStore:
    """A new store in the shared folder."""
    store = SceneStore(spark, hadoop.new_path(spark, "scene"))
    store.create_tables()
    return store


# --- label tables ----------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq(spark, d):
    return tabular.where_equal(_t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_mktsegment", "BUILDING")


@query("SELECT count(*) AS n FROM lineitem")
def count_rows(spark, d):
    return tabular.row_count(_t(spark, d, "lineitem"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1")
def group_count_1(spark, d):
    return tabular.group_count(_t(spark, d, "lineitem"), "l_returnflag")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2")
def group_count_2(spark, d):
    return tabular.group_count(_t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT nullif(p_size % 5, 0) AS k, count(*) AS n FROM part WHERE p_size % 5 <> 0 GROUP BY 1")
def group_count_dropna(spark, d):
    return tabular.group_count(_t(spark, d, "part").select(F.nullif(F.col("p_size") % 5, F.lit(0)).alias("k")), "k")


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IS NOT NULL GROUP BY 1")
def filter_group_count(spark, d):
    return tabular.group_count(tabular.where_equal(_t(spark, d, "customer"), "c_mktsegment", "BUILDING"), "c_nationkey")


@query("SELECT o_custkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS idx, o_totalprice AS v FROM orders")
def multimap(spark, d):
    return tabular.multimap(_t(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey").select(F.col("o_custkey").alias("k"), F.posexplode("values").alias("idx", "v"))


@query("SELECT event_type AS k, (rn - 1) // 100 AS chunk, CAST((rn - 1) % 100 AS INTEGER) AS idx, event_id AS v FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)")
def multimap_hot(spark, d):
    """A few keys that all rows share, in rows of a hundred values."""
    found = tabular.multimap_chunks(_t(spark, d, "events"), "event_type", "event_id", ["event_id"], 100)
    return found.select(F.col("event_type").alias("k"), "chunk", F.posexplode("values").alias("idx", "v"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS dataset, c_mktsegment AS scene, c_name AS thresholds FROM customer")
def csv_labels(spark, d):
    """Customers written as CSV under other names, and read as a label table."""
    path = hadoop.new_path(spark, "labels")
    _t(spark, d, "customer").select(F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b"), F.col("c_name").alias("c")).write.csv(path, header=True)
    return files.read_csv(spark, path, THRESHOLDS)


# --- pair ids --------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select("l_partkey", "l_suppkey", ids.pair_id("l_partkey", "l_suppkey").alias("pair_id"))


_PAIR = f"least(l_partkey, l_suppkey) * {_M} + greatest(l_partkey, l_suppkey)"


@query(f"SELECT l_partkey, l_suppkey, {_PAIR} AS pair_id FROM lineitem")
def pair_encode(spark, d):
    return _pairs(spark, d)


@query(f"SELECT {_PAIR} AS pair_id, least(l_partkey, l_suppkey) AS image_id1, greatest(l_partkey, l_suppkey) AS image_id2 FROM lineitem")
def pair_decode(spark, d):
    return _pairs(spark, d).select("pair_id", ids.first_of("pair_id").alias("image_id1"), ids.second_of("pair_id").alias("image_id2"))


@query(f"SELECT a, b, least(a, b) * {_M} + greatest(a, b) AS pair_id, least(a, b) AS i1, greatest(a, b) AS i2 FROM (SELECT l_partkey + 2147460000 AS a, l_suppkey + 2147460000 AS b FROM lineitem)")
def pair_roundtrip_big(spark, d):
    rows = _t(spark, d, "lineitem").select((F.col("l_partkey") + 2147460000).alias("a"), (F.col("l_suppkey") + 2147460000).alias("b"))
    rows = rows.withColumn("pair_id", ids.pair_id("a", "b"))
    return rows.select("a", "b", "pair_id", ids.first_of("pair_id").alias("i1"), ids.second_of("pair_id").alias("i2"))


@query(f"SELECT pair_id, l_partkey AS a, l_suppkey AS b FROM (SELECT *, {_PAIR} AS pair_id FROM lineitem) WHERE pair_id BETWEEN {3 * _M} AND {3 * _M + _M - 1}")
def pair_prefix_range(spark, d):
    return _pairs(spark, d).where(ids.pairs_with_first(3)).select("pair_id", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))


@query(f"SELECT {_PAIR} AS pair_id, CASE WHEN l_partkey > l_suppkey THEN CAST(l_quantity AS BIGINT) ELSE l_orderkey END AS idx1, CASE WHEN l_partkey > l_suppkey THEN l_orderkey ELSE CAST(l_quantity AS BIGINT) END AS idx2 FROM lineitem")
def match_canonical(spark, d):
    match = F.array(F.struct(F.col("l_orderkey").alias("idx1"), F.col("l_quantity").cast("long").alias("idx2")))
    rows = _t(spark, d, "lineitem").withColumn("m", match)
    return rows.select(ids.pair_id("l_partkey", "l_suppkey").alias("pair_id"), F.inline(ids.canonical("l_partkey", "l_suppkey", "m")))


_ORDER = ["l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"]


@query(f"SELECT pair_id, {', '.join(_ORDER)} FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY {', '.join(_ORDER)}) AS rn FROM (SELECT *, {_PAIR} AS pair_id FROM lineitem)) WHERE rn = 1")
def match_dedup(spark, d):
    return ingest.first_pairs(_t(spark, d, "lineitem").select(*_ORDER), _ORDER, "l_partkey", "l_suppkey")


@query(f"SELECT {_PAIR} AS pair_id, count(*) - 1 AS n_dups FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def match_dup_warnings(spark, d):
    return ingest.duplicate_warnings(_t(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query(f"SELECT {_PAIR} AS pair_id, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY {_PAIR} ORDER BY {', '.join(_ORDER)}) AS INTEGER) AS rank FROM lineitem")
def match_ranks(spark, d):
    return ingest.ranked_pairs(_t(spark, d, "lineitem").select(*_ORDER), _ORDER, "l_partkey", "l_suppkey").select("pair_id", "l_orderkey", "l_linenumber", "rank")


@query("SELECT n, CAST(n * (n - 1) // 2 AS BIGINT) AS total FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem)")
def progress_total(spark, d):
    n = _t(spark, d, "lineitem").agg(F.count_distinct("l_partkey")).first()[0]
    return spark.createDataFrame([(n, ingest.progress_total(n))], "n long, total long")


# --- names, ids and files --------------------------------------------------------------------------


@query("SELECT c_name AS name, CAST(row_number() OVER (ORDER BY c_name) AS BIGINT) AS image_id FROM customer")
def assign_ids(spark, d):
    return tabular.with_ids(_t(spark, d, "customer").select(F.col("c_name").alias("name")), "image_id", [F.col("name")])


def _names(spark: SparkSession, d: str) -> DataFrame:
    part, supplier = _t(spark, d, "part"), _t(spark, d, "supplier")
    return part.select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.col("p_partkey").alias("image_id")).unionByName(supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("name"), (F.col("s_suppkey") + 1_000_000).alias("image_id")))


@query("SELECT p_partkey AS image_id1, s_suppkey + 1000000 AS image_id2 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def resolve_matches(spark, d):
    named = _t(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("name1"), F.concat(F.lit("s"), "l_suppkey").alias("name2"))
    return ingest.resolved(named, _names(spark, d)).where("image_id1 is not null and image_id2 is not null").select("image_id1", "image_id2")


@query("SELECT DISTINCT l_partkey AS key FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = l_partkey)")
def unresolved_keys(spark, d):
    named = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("name1"), F.col("l_partkey").alias("name2"))
    return ingest.unresolved(named, _t(spark, d, "embeddings").select(F.col("vec_id").alias("name"))).select(F.col("name").alias("key"))


# --- cameras ---------------------------------------------------------------------------------------


def _photos(spark: SparkSession, d: str) -> DataFrame:
    film = F.when(F.col("p_size") % 3 == 0, F.col("p_size") % 7)
    return _t(spark, d, "part").select(F.col("p_partkey").alias("image_id"), F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".jpg")).alias("name"), (F.col("p_size") * 16).alias("width"), (F.col("p_size") * 12 + 1).alias("height"), film.alias("film_focal"))


_PHOTOS = "(SELECT p_partkey AS image_id, lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '.jpg' AS name, p_size * 16 AS width, p_size * 12 + 1 AS height, CASE WHEN p_size % 3 = 0 THEN p_size % 7 END AS film_focal FROM part)"
_FOCAL = "coalesce(film_focal / 35.0 * greatest(width, height), 1.2 * greatest(width, height))"
_FOCAL_D = "CAST(CASE WHEN film_focal IS NOT NULL THEN CAST(film_focal AS DOUBLE) / 35 * greatest(width, height) ELSE CAST(1.2 AS DOUBLE) * greatest(width, height) END AS DOUBLE)"


@query(f"SELECT image_id, round({_FOCAL_D}, 6) AS focal, CASE WHEN film_focal IS NULL THEN 'default' ELSE 'exif' END AS source FROM {_PHOTOS}")
def focal_prior(spark, d):
    f = cameras.focal(F.col("width"), F.col("height"), F.col("film_focal"))
    return _photos(spark, d).select("image_id", F.round(f, 6).alias("focal"), cameras.focal_source(F.col("film_focal")).alias("source"))


_W2, _H2 = "CAST(width AS DOUBLE) / 2", "CAST(height AS DOUBLE) / 2"


@query(
    f"WITH p AS (SELECT image_id, CAST(CASE image_id % 4 WHEN 3 THEN 4 ELSE image_id % 4 END AS INTEGER) AS model, {_FOCAL_D} AS f, {_W2} AS x, {_H2} AS y FROM {_PHOTOS}), "
    "q AS (SELECT image_id, model, CASE model WHEN 0 THEN [f, x, y] WHEN 1 THEN [f, f, x, y] WHEN 2 THEN [f, x, y, 0.1::DOUBLE] ELSE [f, f, x, y, 0, 0, 0, 0] END AS v FROM p) "
    "SELECT image_id, model, CAST(i - 1 AS INTEGER) AS idx, round(v[i], 6) AS value FROM q, range(1, 9) t(i) WHERE i <= len(v)"
)
def camera_params(spark, d):
    rows = _photos(spark, d).withColumn("model", F.when(F.col("image_id") % 4 == 3, 4).otherwise(F.col("image_id") % 4).cast("int"))
    f = cameras.focal(F.col("width"), F.col("height"), F.col("film_focal"))
    rows = rows.withColumn("params", cameras.params(F.col("model"), f, F.col("width"), F.col("height")))
    return rows.select("image_id", "model", F.posexplode("params").alias("idx", "v")).select("image_id", "model", "idx", F.round("v", 6).alias("value"))


@query(f"SELECT p.name AS image, 1::BIGINT AS camera_id, f.width, f.height FROM {_PHOTOS} p CROSS JOIN (SELECT * FROM {_PHOTOS} ORDER BY name LIMIT 1) f")
def camera_single(spark, d):
    photos = _photos(spark, d)
    one = ingest.camera_rows(photos, single=True).first()  # one row
    return photos.select(F.col("name").alias("image"), F.lit(1).cast("long").alias("camera_id"), F.lit(one["width"]).alias("width"), F.lit(one["height"]).alias("height"))


@query(f"SELECT name AS image, CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS camera_id, width, height FROM {_PHOTOS}")
def camera_multi(spark, d):
    return tabular.with_ids(ingest.camera_rows(_photos(spark, d)).select(F.col("name").alias("image"), "width", "height"), "camera_id", [F.col("image")])


@query("SELECT CAST(row_number() OVER (ORDER BY p_partkey) + 10 AS BIGINT) AS camera_id, CAST(0 AS INTEGER) AS model, p_size AS width, p_size AS height, CAST(0 AS INTEGER) AS prior_focal_length FROM part")
def add_camera(spark, d):
    store = _store(spark)
    store.add_camera(0, 1, 1, [1.0], camera_id=10)
    rows = _t(spark, d, "part").select("p_partkey", F.lit(0).alias("model"), F.col("p_size").alias("width"), F.col("p_size").alias("height"), F.array(F.lit(1.0)).alias("params"))
    store.add_cameras(rows, order=["p_partkey"])
    return store.table("cameras").where("camera_id > 10").select("camera_id", "model", "width", "height", "prior_focal_length")


_ZEROS = [f"prior_{c}" for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")]


@query(f"SELECT CAST(row_number() OVER (ORDER BY c_name) AS BIGINT) AS image_id, c_name AS name, c_custkey AS camera_id, {', '.join(f'0.0::DOUBLE AS {z}' for z in _ZEROS)} FROM customer")
def add_image(spark, d):
    store = _store(spark)
    store.add_images(_t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("camera_id")))
    return store.table("images")


# --- keypoints and descriptors ---------------------------------------------------------------------


def _keypoints(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, rows, cols, data): the events of each user as (event_id, value)."""
    point = F.struct(F.col("event_id").alias("o"), F.array(F.col("event_id").cast("float"), F.col("value").cast("float")).alias("p"))
    rows = _t(spark, d, "events").groupBy(F.col("user_id").alias("image_id")).agg(F.array_sort(F.collect_list(point)).alias("s"))
    return rows.select("image_id", F.size("s").alias("rows"), F.lit(2).alias("cols"), F.transform("s", lambda x: x["p"]).alias("data"))


def _stored_keypoints(spark: SparkSession, d: str) -> SceneStore:
    store = _store(spark)
    store.add_keypoints(_keypoints(spark, d))
    return store


def _exploded(rows: DataFrame) -> DataFrame:
    rows = rows.select("image_id", F.posexplode("data").alias("pos", "p"))
    return rows.select("image_id", "pos", F.round(F.col("p")[0].cast("double"), 3).alias("x"), F.round(F.col("p")[1].cast("double"), 3).alias("y"))


_XY = "CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS pos, round(CAST(CAST(event_id AS FLOAT) AS DOUBLE), 3) AS x, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) AS y"


@query("SELECT user_id AS image_id, CAST(count(*) AS INTEGER) AS rows, CAST(2 AS INTEGER) AS cols FROM events GROUP BY 1")
def keypoints_pack(spark, d):
    return _stored_keypoints(spark, d).table("keypoints").select("image_id", "rows", "cols")


@query(f"SELECT user_id AS image_id, {_XY} FROM events")
def keypoints_unpack(spark, d):
    return _exploded(_keypoints(spark, d))


@query(f"SELECT user_id AS image_id, {_XY} FROM events")
def stored_keypoints(spark, d):
    """As keypoints_unpack, from the store."""
    return _exploded(_stored_keypoints(spark, d).table("keypoints"))


@query(f"SELECT user_id AS image_id, {_XY} FROM events WHERE user_id % 7 <> 1 UNION ALL SELECT DISTINCT user_id + 1000000, CAST(0 AS INTEGER), 3.0::DOUBLE, 4.0::DOUBLE FROM events")
def compact_kp(spark, d):
    """Keypoints in two folders, a third of new images, some deleted, and all folded into one folder."""
    store, rows = _store(spark), _keypoints(spark, d)
    store.add_keypoints(rows.where("image_id % 2 = 0"))
    store.add_keypoints(rows.where("image_id % 2 = 1"))
    store.add_keypoints(rows.select((F.col("image_id") + 1_000_000).alias("image_id"), F.array(F.array(F.lit(3.0), F.lit(4.0))).alias("data")))
    store.delete_keypoints(rows.where("image_id % 7 = 1").select("image_id"))
    store.compact("keypoints")
    store.vacuum()
    return _exploded(store.table("keypoints"))


@query("SELECT p_partkey AS id, CAST(p_size % 8 AS INTEGER) AS cols, p_size % 8 IN (2, 4, 6) AS ok FROM part")
def keypoints_format_check(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 8).cast("int").alias("cols"))
    return rows.withColumn("ok", valid_layout("cols"))


@query(f"SELECT user_id AS image_id, {_XY} FROM events WHERE user_id = 3")
def select_kp(spark, d):
    return _exploded(_stored_keypoints(spark, d).rows_of("keypoints", 3))


@query(f"SELECT user_id AS image_id, {_XY} FROM events WHERE user_id NOT IN (1, 2, 1000000)")
def delete_kp(spark, d):
    store = _stored_keypoints(spark, d)
    store.delete_keypoints([1, 2, 1_000_000])
    return _exploded(store.table("keypoints"))


@query(f"SELECT user_id AS image_id, {_XY} FROM events WHERE user_id % 5 <> 0 UNION ALL SELECT DISTINCT user_id, CAST(0 AS INTEGER), 1.0::DOUBLE, 2.0::DOUBLE FROM events WHERE user_id % 5 = 0")
def replace_kp(spark, d):
    store = _stored_keypoints(spark, d)
    new = _t(spark, d, "events").where("user_id % 5 = 0").select(F.col("user_id").alias("image_id"), F.array(F.array(F.lit(1.0), F.lit(2.0))).alias("data")).distinct()
    store.replace_keypoints(new)
    return _exploded(store.table("keypoints"))


def _descriptors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: ids.uint8(v.cast("double") * 1000)).alias("data"))


def _stored_descriptors(spark: SparkSession, d: str) -> SceneStore:
    """Each embedding as an image's one descriptor."""
    store = _store(spark)
    store.add_descriptors(_t(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.array(F.transform("embedding", lambda v: v.cast("double") * 1000)).alias("data")))
    return store


def _one_descriptor(rows: DataFrame) -> DataFrame:
    return _bytes(rows.select(F.col("image_id").alias("vec_id"), F.col("data")[0].alias("data")))


def _bytes(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", F.posexplode("data").alias("pos", "u8")).withColumn("u8", F.col("u8").cast("int"))


_U8 = "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(((CAST(trunc(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT) % 256) + 256) % 256 AS INTEGER) AS u8 FROM embeddings, range(1, 4097) t(i) WHERE i <= len(embedding)"


@query(_U8)
def descriptors_u8(spark, d):
    return _bytes(_descriptors(spark, d))


@query(_U8)
def add_descriptors(spark, d):
    return _one_descriptor(_stored_descriptors(spark, d).table("descriptors"))


@query(f"SELECT * FROM ({_U8}) WHERE vec_id = 7")
def select_descriptors(spark, d):
    return _one_descriptor(_stored_descriptors(spark, d).rows_of("descriptors", 7))


@query(f"SELECT * FROM ({_U8}) WHERE vec_id NOT IN (7, 8, 1000000)")
def delete_desc(spark, d):
    store = _stored_descriptors(spark, d)
    store.delete_descriptors([7, 8, 1_000_000])
    return _one_descriptor(store.table("descriptors"))


@query(f"SELECT * FROM ({_U8}) WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id, CAST(0 AS INTEGER), CAST(255 AS INTEGER) FROM embeddings WHERE vec_id % 5 = 0")
def replace_desc(spark, d):
    store = _stored_descriptors(spark, d)
    store.replace_descriptors(_t(spark, d, "embeddings").where("vec_id % 5 = 0").select(F.col("vec_id").alias("image_id"), F.array(F.array(F.lit(-1.0))).alias("data")))
    return _one_descriptor(store.table("descriptors"))


# --- reads -----------------------------------------------------------------------------------------


def _stored_images(spark: SparkSession, d: str) -> SceneStore:
    store = _store(spark)
    store.add_images(_t(spark, d, "customer").select(F.col("c_custkey").alias("image_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("camera_id")))
    return store


@query("SELECT c_custkey AS image_id, c_name AS name, c_nationkey AS camera_id FROM customer WHERE c_custkey = 5")
def select_image(spark, d):
    return _stored_images(spark, d).rows_of("images", 5).select("image_id", "name", "camera_id")


def _named(spark: SparkSession, d: str, rest: int) -> DataFrame:
    """The customers whose key leaves ``rest`` when divided by three, as images."""
    return _t(spark, d, "customer").where(F.col("c_custkey") % 3 == rest).select(F.col("c_custkey").alias("image_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("camera_id"))


@query("SELECT c_custkey AS image_id, c_name AS name, c_nationkey AS camera_id FROM customer WHERE c_custkey % 3 <> 1")
def transactions(spark, d):
    """Of three parts the first is written at once, the second in a transaction that fails, the last by a source that writes it twice."""
    store = _store(spark)
    store.add_images(_named(spark, d, 0))
    with contextlib.suppress(ConstraintError), store.transaction():
        store.add_images(_named(spark, d, 1))
        store.add_images(_named(spark, d, 0))
    for _ in range(2):
        with store.transaction("customers", 1) as new:
            if new:
                store.add_images(_named(spark, d, 2))
    return store.table("images").select("image_id", "name", "camera_id")


@query("SELECT c_custkey AS image_id, c_name AS name, c_nationkey AS camera_id FROM customer WHERE c_custkey % 3 <> 1")
def rejected_appends(spark, d):
    """Appends of which any id or name is there already add nothing."""
    store = _store(spark)
    store.add_images(_named(spark, d, 0).unionByName(_named(spark, d, 2)))
    for same in ("image_id", "name"):
        other = {"image_id": F.col("image_id") + 10_000_000, "name": F.concat(F.lit("x"), F.col("name"))}
        rows = _named(spark, d, 1).unionByName(_named(spark, d, 2).withColumns({k: v for k, v in other.items() if k != same}))
        with contextlib.suppress(ConstraintError):
            store.add_images(rows)
    return store.table("images").select("image_id", "name", "camera_id")


@query("WITH u AS (SELECT DISTINCT user_id FROM events), i AS (SELECT user_id, row_number() OVER (ORDER BY 'u' || user_id) AS image_id FROM u) "
    f"SELECT least(a.image_id, b.image_id) * {_M} + greatest(a.image_id, b.image_id) AS pair_id, a.user_id AS low, b.user_id AS high, CAST(100 + a.user_id AS INTEGER) AS width FROM i a JOIN i b ON b.user_id = a.user_id + 1")
def import_scene(spark, d):
    """A whole import: each user an image with its events as keypoints, matched with the next user's, and its camera."""
    users = _t(spark, d, "events").select("user_id").distinct()
    name = F.concat(F.lit("u"), F.col("user_id"))
    photos = users.select(name.alias("name"), (F.col("user_id") + 100).cast("int").alias("width"), F.lit(50).alias("height"), F.lit(None).cast("int").alias("film_focal"))
    kps = _keypoints(spark, d).select(F.concat(F.lit("u"), F.col("image_id")).alias("name"), F.col("data").alias("kps"))
    nexts = users.join(users.select((F.col("user_id") - 1).alias("user_id")), "user_id")
    pairs = nexts.select(F.concat(F.lit("u"), F.col("user_id") + 1).alias("name1"), name.alias("name2"), F.array(F.array((F.col("user_id") + 1).cast("int"), F.col("user_id").cast("int"))).alias("matches"))
    root = hadoop.new_path(spark, "scene")
    ingest.import_scene(spark, root, photos, kps, pairs)
    store = SceneStore(spark, root)
    named = store.table("images").select("camera_id", F.substring("name", 2, 20).cast("long").alias("low")).join(store.table("cameras").select("camera_id", "width"), "camera_id")
    match = F.col("matches")[0]
    rows = store.table("matches").select("pair_id", F.least(match["idx1"], match["idx2"]).alias("low"), F.greatest(match["idx1"], match["idx2"]).alias("high"))
    return rows.join(named, "low").select("pair_id", "low", "high", "width")


_FIRST = f"SELECT {_PAIR} AS pair_id, {', '.join(_ORDER)}, row_number() OVER (PARTITION BY {_PAIR} ORDER BY {', '.join(_ORDER)}) AS rn FROM lineitem"
_STORED = f"SELECT pair_id, CASE WHEN l_partkey > l_suppkey THEN l_linenumber ELSE l_orderkey END AS idx1, CASE WHEN l_partkey > l_suppkey THEN l_orderkey ELSE l_linenumber END AS idx2 FROM ({_FIRST}) WHERE rn = 1"


def _stored_matches(spark: SparkSession, d: str) -> SceneStore:
    """The first lineitem of each pair as its one match."""
    first = ingest.first_pairs(_t(spark, d, "lineitem").select(*_ORDER), _ORDER, "l_partkey", "l_suppkey")
    match = F.array(F.struct(F.col("l_orderkey").cast("long").alias("idx1"), F.col("l_linenumber").cast("long").alias("idx2")))
    store = _store(spark)
    store.add_matches(first.select(F.col("l_partkey").alias("image_id1"), F.col("l_suppkey").alias("image_id2"), match.alias("matches")))
    return store


@query(f"SELECT pair_id, CAST(idx1 AS BIGINT) AS idx1, CAST(idx2 AS BIGINT) AS idx2 FROM ({_STORED})")
def add_matches(spark, d):
    return _stored_matches(spark, d).table("matches").select("pair_id", F.inline("matches"))


@query(f"SELECT pair_id, CAST(idx1 AS BIGINT) AS idx1, CAST(idx2 AS BIGINT) AS idx2 FROM ({_STORED}) WHERE pair_id IN (SELECT {_PAIR} FROM lineitem WHERE l_orderkey = 7)")
def select_matches(spark, d):
    # either order of the ids asks for the same pair
    asked = _t(spark, d, "lineitem").where("l_orderkey = 7").select(F.col("l_suppkey").alias("image_id1"), F.col("l_partkey").alias("image_id2"))
    return _stored_matches(spark, d).matches_of(asked).select("pair_id", F.inline("matches"))


@query("SELECT c_custkey AS image_id, c_name AS name, c_nationkey AS camera_id FROM customer")
def fetch_images(spark, d):
    return _stored_images(spark, d).table("images").select("image_id", "name", "camera_id")


@query("SELECT c_custkey AS image_id FROM customer")
def image_ids(spark, d):
    return _stored_images(spark, d).image_ids()


@query("SELECT least(l_partkey, l_suppkey) AS id1, greatest(l_partkey, l_suppkey) AS id2, l_orderkey AS idx1, l_linenumber AS idx2 FROM lineitem")
def matches_project(spark, d):
    rows = _t(spark, d, "lineitem").select(ids.pair_id("l_partkey", "l_suppkey").alias("p"), "l_orderkey", "l_linenumber")
    return rows.select(ids.first_of("p").alias("id1"), ids.second_of("p").alias("id2"), F.col("l_orderkey").alias("idx1"), F.col("l_linenumber").alias("idx2"))


@query(f"SELECT DISTINCT {_PAIR} AS pair_id, CAST(2 AS INTEGER) AS config, CAST(i AS INTEGER) AS f_idx, CASE WHEN i % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f FROM lineitem, range(9) t(i)")
def two_view_defaults(spark, d):
    first = ingest.first_pairs(_t(spark, d, "lineitem").select(*_ORDER), _ORDER, "l_partkey", "l_suppkey")
    store = _store(spark)
    store.add_two_view_geometries(first.select(F.col("l_partkey").alias("image_id1"), F.col("l_suppkey").alias("image_id2"), F.array().cast("array<struct<idx1:long,idx2:long>>").alias("matches")))
    return store.table("two_view_geometries").select("pair_id", "config", F.posexplode("F").alias("f_idx", "f"))


@query("SELECT c_nationkey AS camera_id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 2")
def sql_views(spark, d):
    store = _stored_images(spark, d)
    store.add_cameras(_t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("camera_id"), F.lit(0).alias("model"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.array(F.lit(1.0)).alias("params")))
    return store.sql("SELECT camera_id, count(*) AS n FROM images JOIN cameras USING (camera_id) GROUP BY camera_id HAVING count(*) > 2")


# --- geometry --------------------------------------------------------------------------------------


def _poses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("double")
    q = (k % 3 + 1, k % 5 - 2, k % 7 - 3, k % 2)
    t = F.array(k, k % 11 - 5, F.lit(2.0))
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), g.rotation_from_quaternion(*q).alias("r"), t.alias("t"))


_POSES = """
(SELECT id, [(n - 2*(y*y + z*z))/n, 2*(x*y - w*z)/n, 2*(x*z + w*y)/n, 2*(x*y + w*z)/n, (n - 2*(x*x + z*z))/n, 2*(y*z - w*x)/n, 2*(x*z - w*y)/n, 2*(y*z + w*x)/n, (n - 2*(x*x + y*y))/n] AS r,
  [k, k % 11 - 5, 2.0::DOUBLE] AS t
 FROM (SELECT *, w*w + x*x + y*y + z*z AS n FROM (SELECT s_suppkey AS id, CAST(s_suppkey AS DOUBLE) AS k, CAST(s_suppkey % 3 + 1 AS DOUBLE) AS w, CAST(s_suppkey % 5 - 2 AS DOUBLE) AS x, CAST(s_suppkey % 7 - 3 AS DOUBLE) AS y, CAST(s_suppkey % 2 AS DOUBLE) AS z FROM supplier)))
"""
_CENTER = ", ".join(f"-(r[{i}]*t[1] + r[{i + 3}]*t[2] + r[{i + 6}]*t[3]) AS c{n}" for i, n in enumerate("xyz", 1))


def _rounded(df: DataFrame) -> DataFrame:
    """Six digits, and no negative zeros."""
    return df.select(*(F.round(c, 6).__add__(0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


@query(f"SELECT id, {_r('cx')} AS x, {_r('cy')} AS y, {_r('cz')} AS z FROM (SELECT id, {_CENTER} FROM {_POSES})")
def camera_center(spark, d):
    c = g.camera_center(F.col("r"), F.col("t"))
    return _rounded(_poses(spark, d).select("id", *(c[n].alias(n) for n in g.XYZ)))


@query(
    "SELECT id, ['xaxis', 'yaxis', 'zaxis'][i] AS axis, ['rgb(255, 0, 0)', 'rgb(0, 255, 0)', 'rgb(0, 0, 255)'][i] AS color, "
    + ", ".join(f"{_r(f'c{n}')} AS {n}0" for n in "xyz")
    + ", "
    + ", ".join(f"{_r(f'c{n} + 0.5 * r[3 * (i - 1) + {j}]')} AS {n}1" for j, n in enumerate("xyz", 1))
    + f" FROM (SELECT id, r, {_CENTER} FROM {_POSES}), range(1, 4) t(i)"
)
def camera_axes(spark, d):
    return _rounded(scene.pose_axes(_poses(spark, d), ["id"], F.col("r"), F.col("t"), scale=0.5))


def _points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return _t(spark, d, "part").select(k.alias("id"), g.point(k % 10, k % 7 - 3, F.col("p_size") % 4).alias("p"))


_POINTS = "(SELECT p_partkey AS id, CAST(p_partkey % 10 AS DOUBLE) AS x, CAST(p_partkey % 7 - 3 AS DOUBLE) AS y, CAST(p_size % 4 AS DOUBLE) AS z FROM part)"


@query(f"SELECT id, x, y, z, 'red' AS color FROM {_POINTS}")
def points3d(spark, d):
    return scene.points(_points(spark, d), F.col("p"), "red").drop("p")


@query(f"SELECT id, CAST(0 AS INTEGER) AS pos, 'rgb(255, 0, 0)' AS rgb, 1.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 0.0::DOUBLE AS z0, 1 + 2 * x AS x1, 2 * y AS y1, 2 * z AS z1 FROM {_POINTS}")
def od_rays(spark, d):
    return scene.rays(_points(spark, d), ["id"], g.point(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.array("p"), scale=2.0)


@query(
    "SELECT id, CAST(0 AS INTEGER) AS pos, 'rgb(255, 0, 0)' AS rgb, 1.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 0.0::DOUBLE AS z0, "
    + ", ".join(f"CASE WHEN s > 0 THEN {_r(f'{o} + d{n} / s')} END AS {n}1" for n, o in zip("xyz", ("1.0", "0.0", "0.0"), strict=True))
    + f" FROM (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS s FROM (SELECT id, x - 1 AS dx, y AS dy, z AS dz FROM {_POINTS}))"
)
def diff_rays(spark, d):
    return _rounded(scene.rays_to(_points(spark, d), ["id"], g.point(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.array("p")))


def _rect() -> Column:
    return F.array(*(g.point(F.lit(x), F.lit(y), F.lit(1.0)) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))))


_CORNERS = "[0, 1, 1, 0][{i}] * 1.0::DOUBLE AS {x}, [0, 0, 1, 1][{i}] * 1.0::DOUBLE AS {y}, 1.0::DOUBLE AS {z}"


def _stands() -> Column:
    k = F.col("s_suppkey")
    return g.point(k, k % 11 - 5, F.lit(2.0))


@query(
    "SELECT s_suppkey AS id, CAST(i - 1 AS INTEGER) AS edge, 'rgb(255, 0, 255)' AS rgb, CAST(s_suppkey AS DOUBLE) AS x0, CAST(s_suppkey % 11 - 5 AS DOUBLE) AS y0, 2.0::DOUBLE AS z0, "
    "[0, 1, 1, 0][i] * 3.0::DOUBLE AS x1, [0, 0, 1, 1][i] * 3.0::DOUBLE AS y1, 3.0::DOUBLE AS z1 FROM supplier, range(1, 5) t(i)"
)
def frustum_edges(spark, d):
    return scene.frustum_edges(_t(spark, d, "supplier").withColumn("id", F.col("s_suppkey")), ["id"], _stands(), _rect(), scale=3.0)


@query(
    "SELECT s_suppkey AS id, CAST(f AS INTEGER) AS face, CAST(k AS INTEGER) AS corner, 'rgb(255, 0, 255)' AS rgb, 0.5::DOUBLE AS opacity, "
    + _CORNERS.format(i="[1, 2, 3, 1, 3, 4][f * 3 + k + 1]", x="x", y="y", z="z")
    + " FROM supplier, range(2) a(f), range(3) b(k)"
)
def frustum_faces(spark, d):
    return scene.frustum_faces(_t(spark, d, "supplier").withColumn("id", F.col("s_suppkey")), ["id"], _rect())


# --- options, catalogues, pixels, files ------------------------------------------------------------

_GROUPS = ("click", "view")
#: The label table's columns, of customers.
_LABELS = {"dataset": "c_nationkey", "scene": "c_mktsegment", "image": "c_name"}


@query("SELECT key, CASE WHEN split_part(key, ':', 1) IN ('click', 'view') THEN split_part(key, ':', 1) END AS grp, CASE WHEN split_part(key, ':', 1) IN ('click', 'view') THEN substr(key, strpos(key, ':') + 1) ELSE key END AS name, n FROM (SELECT event_type || ':n' || (user_id % 2) || ':m' AS key, count(*) AS n FROM events GROUP BY 1)")
def option_groups(spark, d):
    key = F.concat("event_type", F.lit(":n"), (F.col("user_id") % 2).cast("string"), F.lit(":m"))
    rows = _t(spark, d, "events").groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    return rows.select("key", options.option_group(F.col("key"), _GROUPS).alias("grp"), options.option_name(F.col("key"), _GROUPS).alias("name"), "n")


@query(" UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS ordinal, '{n}' AS name, count({_LABELS[n]}) AS n FROM customer" for k, n in enumerate(sorted(_LABELS))))
def column_catalog(spark, d):
    """The catalogue's columns of the label table as it is read, in the order of their names, and how many values each has."""
    rows = _t(spark, d, "customer").select([F.col(c).alias(n) for n, c in _LABELS.items()])
    counts = rows.select([F.count(n).alias(n) for n in columns(rows.schema)])
    names = sorted(columns(rows.schema))
    return counts.select(F.posexplode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names))).alias("ordinal", "r")).select("ordinal", "r.*")


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(((CAST(trunc(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT) % 256) + 256) % 256 / 255.0::DOUBLE, 6) AS v FROM embeddings, range(1, 4097) t(i) WHERE i <= len(embedding)")
def image_prep(spark, d):
    rows = _descriptors(spark, d).withColumn("data", embed.scaled_pixels(F.col("data")))
    return rows.select("vec_id", F.posexplode("data").alias("pos", "v")).withColumn("v", F.round("v", 6))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, true AS same FROM embeddings")
def blob_roundtrip(spark, d):
    from ..functions.blobs import from_blob, to_blob

    rows = _t(spark, d, "embeddings").select("vec_id", "embedding", from_blob(to_blob(F.col("embedding"), "<f4"), "<f4").alias("again"))
    return rows.select("vec_id", F.size("again").alias("n"), (F.col("embedding") == F.col("again")).alias("same"))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}.parquet', true)" for t in _TABLES) + ") t(name, filled)")
def file_listing(spark, d):
    """The tables' files; a table that is a folder counts once."""
    name = F.regexp_extract("path", r"/([^/]+\.parquet)(?:/[^/]+)?$", 1)
    return files.listing(spark, d).groupBy(name.alias("name")).agg((F.sum("length") > 0).alias("filled")).where("name <> ''")


@query("SELECT vec_id, CAST(c * 64 + i - 1 AS INTEGER) AS pos, round(((CAST(trunc(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT) % 256) + 256) % 256 / 255.0::DOUBLE, 4) AS v FROM embeddings, range(1, 65) a(i), range(3) b(c)")
def image_batch(spark, d):
    """Each descriptor as 8 x 8 grey pixels, in a batch of one, channels first."""
    grey = F.flatten(F.transform("data", lambda v: F.array(v, v, v)))
    rows = _descriptors(spark, d).select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), grey.alias("data"))
    return embed.batches(rows, "vec_id").select("vec_id", F.posexplode("pixels").alias("pos", "v")).withColumn("v", F.round(F.col("v").cast("double"), 4))
