import contextlib
import inspect
import json
import random
import sqlite3
import struct
import sys
import types
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn import cli
from skarn.functions import blobs
from skarn.operators import embed, ingest, scene, tabular
from skarn.operators.store import IDENTITY, ConstraintError, SceneStore
from skarn.plans import figure
from skarn.sources import files, hdf5, sqlite
from skarn.sources.schema import MAX_ID, THRESHOLDS
from skarn.streaming.matches import stream_matches


@pytest.fixture
def store(spark, tmp_path):
    s = SceneStore(spark, str(tmp_path / "scene"))
    s.create_tables()
    return s


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_round_trip(spark, store):
    rng = np.random.default_rng(1)
    store.create_tables()  # nothing happens
    cams = [(0, 1024, 768, [1024.0, 512.0, 384.0]), (2, 1024, 768, [1024.0, 512.0, 384.0, 0.1])]
    numbers = [store.add_camera(*c) for c in cams]
    assert numbers == [1, 2]
    assert [store.add_image(f"image{i}.png", numbers[i // 3]) for i in range(1, 5)] == [1, 2, 3, 4]
    kps = {i: (rng.random((100, 2)) * [1024, 768]).astype(np.float32) for i in range(1, 5)}
    store.add_keypoints(frame(spark, [(i, k.tolist()) for i, k in kps.items()], "image_id long, data array<array<float>>"))
    pairs = {(i, i + 1): rng.integers(0, 100, (50, 2)) for i in range(1, 4)}
    store.add_matches(frame(spark, [(a, b, m.tolist()) for (a, b), m in pairs.items()], "image_id1 long, image_id2 long, m array<array<long>>").select("image_id1", "image_id2", F.transform("m", lambda x: F.struct(x[0].alias("idx1"), x[1].alias("idx2"))).alias("matches")))
    assert [(r["model"], r["params"]) for r in store.table("cameras").orderBy("camera_id").collect()] == [(c[0], c[3]) for c in cams]
    assert np.array_equal(np.array(store.select_keypoints(3), np.float32), kps[3]) and store.select_keypoints(9) is None
    for (a, b), m in pairs.items():
        assert [tuple(r) for r in store.select_matches(b, a)] == [tuple(r) for r in m.tolist()]
    assert store.select_image(2)["name"] == "image2.png" and store.select_image(2)["prior_qw"] == 0.0
    with pytest.raises(KeyError):
        store.select_image(77)
    assert sorted(store.select_image_ids(eager=True)) == [1, 2, 3, 4] and len(list(store.fetch_images())) == 4
    assert isinstance(store.fetch_images(eager=True, as_dict=False)[0], tuple)
    assert store.sql("SELECT count(*) AS n FROM images JOIN cameras USING (camera_id)").first()["n"] == 4
    store.validate_refs()


def test_ids_are_never_given_again(store):
    assert store.add_camera(0, 1, 1, [1.0], camera_id=10) == 10
    assert store.add_camera(0, 1, 1, [1.0]) == 11
    with pytest.raises(ConstraintError):
        store.add_camera(0, 1, 1, [1.0], camera_id=11)
    store.add_image("a", 99, image_id=MAX_ID - 1)
    for name, number in (("a", 5), ("b", MAX_ID), ("c", -1)):
        with pytest.raises(ConstraintError):
            store.add_image(name, 99, image_id=number)
    with pytest.raises(ConstraintError):
        store.validate_refs()


def test_keypoints_and_descriptors(spark, store):
    add = "image_id long, data array<array<double>>"
    store.add_keypoints(frame(spark, [(1, [[1.0, 2.0]]), (2, [[1.0] * 4]), (3, [[1.0] * 6]), (4, [])], add))
    for bad in ([(5, [[1.0] * 3])], [(1, [[1.0, 2.0]])], [(6, [[1.0, 2.0]]), (6, [[1.0, 2.0]])], [(7, [[1.0, 2.0], [1.0]])]):
        with pytest.raises(ConstraintError):
            store.add_keypoints(frame(spark, bad, add))
    store.replace_keypoints(frame(spark, [(1, [[9.0, 9.0]]), (8, [[8.0, 8.0]])], add))
    assert store.select_keypoints(1) == [[9.0, 9.0]] and store.select_keypoints(8) == [[8.0, 8.0]]
    store.delete_keypoints(1)
    store.delete_keypoints([2, 500])
    store.delete_keypoints(frame(spark, [(3,)], "image_id long"))
    assert sorted(r[0] for r in store.table("keypoints").select("image_id").collect()) == [4, 8]
    store.add_descriptors(frame(spark, [(1, [[3.9, 300.0, -1.0]])], add))
    assert store.select_descriptors(1) == [[3, 44, 255]] and store.select_descriptors(2) is None
    store.replace_descriptors(frame(spark, [(1, [[1.0]])], add))
    assert store.select_descriptors(1) == [[1]]
    store.delete_descriptors([1])
    assert store.table("descriptors").count() == 0


def test_pairs(spark, store):
    schema = "image_id1 long, image_id2 long, matches array<struct<idx1:long,idx2:long>>"
    store.add_matches(frame(spark, [(5, 2, [(1, 9), (2, 8)]), (7, 7, [(0, 0)])], schema))
    assert [tuple(r) for r in store.select_matches(5, 2)] == [(9, 1), (8, 2)]
    for bad in ([(2, 5, [])], [(3, 4, []), (4, 3, [])], [(-1, 4, [])], [(1, MAX_ID, [])]):
        with pytest.raises(ConstraintError):
            store.add_matches(frame(spark, bad, schema))
    store.add_two_view_geometries(frame(spark, [(5, 2, [(1, 9)], [float(i) for i in range(9)])], schema + ", F array<double>"))
    r = store.table("two_view_geometries").first()
    assert r["config"] == 2 and r["F"] == [float(i) for i in range(9)] and r["E"] == [1.0, 0, 0, 0, 1, 0, 0, 0, 1] and tuple(r["matches"][0]) == (9, 1)


def images(spark):
    return frame(spark, [("b.png", 40, 20, None), ("a.png", 10, 30, 70), ("c.png", 8, 8, 0)], "name string, width int, height int, film_focal int")


KPS = "name string, kps array<array<float>>"
PAIRS = "name1 string, name2 string, matches array<array<int>>"


def test_import(spark, tmp_path):
    kps = frame(spark, [(n, [[1.0, 2.0]]) for n in ("c.png", "a.png", "b.png")], KPS)
    pairs = frame(spark, [("b.png", "a.png", [[1, 2]]), ("a.png", "b.png", [[5, 6]]), ("a.png", "c.png", [[0, 3]])], PAIRS)
    root = str(tmp_path / "s")
    twice = ingest.import_scene(spark, root, images(spark), kps, pairs)
    assert [tuple(r) for r in twice.collect()] == [(1 * MAX_ID + 2, 1)]
    s = SceneStore(spark, root)
    assert [(r["image_id"], r["name"], r["camera_id"]) for r in s.table("images").orderBy("image_id").collect()] == [(1, "a.png", 1), (2, "b.png", 2), (3, "c.png", 3)]
    assert [r["params"] for r in s.table("cameras").orderBy("camera_id").collect()] == [[60.0, 5.0, 15.0, 0.1], [48.0, 20.0, 10.0, 0.1], [0.0, 4.0, 4.0, 0.1]]
    assert [tuple(r) for r in s.select_matches(1, 2)] == [(5, 6)]
    ingest.import_scene(spark, str(tmp_path / "one"), images(spark), kps, pairs, single_camera=True, camera_model="opencv")
    assert SceneStore(spark, str(tmp_path / "one")).table("cameras").count() == 1
    def again(name="x", spark=spark, images=images(spark), kps=kps, pairs=pairs, **more):
        ingest.import_scene(spark, str(tmp_path / name), images, kps, pairs, **more)

    unknown = frame(spark, [("a.png", "zz", [[0, 0]])], PAIRS)
    with pytest.raises(ValueError):
        again(camera_model="opencv")
    with pytest.raises(KeyError, match="zz"):
        again(pairs=unknown)
    with pytest.raises(ValueError, match="repeats"):
        again(images=images(spark).unionByName(images(spark)))
    # what fails after some tables are written leaves nothing
    with pytest.raises(ValueError, match="unequal|columns"):
        again(kps=frame(spark, [(n, [[1.0] * 3]) for n in ("c.png", "a.png", "b.png")], KPS))
    assert not SceneStore(spark, str(tmp_path / "x")).exists()
    again(refuse_existing=True)
    with pytest.raises(KeyError):
        ingest.import_scene(spark, root, images(spark), kps, unknown)
    assert {t: s.table(t).count() for t in ("cameras", "images", "matches")} == {"cameras": 3, "images": 3, "matches": 2}
    with pytest.raises(FileExistsError):
        ingest.import_scene(spark, root, images(spark), kps, pairs, refuse_existing=True)


def test_transactions(spark, store):
    with pytest.raises(ConstraintError), store.transaction():
        store.add_camera(0, 1, 1, [1.0])
        assert store.table("cameras").count() == 1 and SceneStore(spark, store.root).table("cameras").count() == 0
        store.add_image("a", 1, image_id=-1)
    assert store.table("cameras").count() == 0 and store.next_id("cameras") == 1
    with store.transaction():
        store.add_camera(0, 1, 1, [1.0])
        store.add_image("a", 1)
    other = SceneStore(spark, store.root)
    assert other.table("images").count() == other.table("cameras").count() == 1
    with pytest.raises(Exception, match="exist"), store.transaction():  # of two writers of one version the second fails
        store.add_image("b", 1)
        other.add_image("c", 1)
    assert [r["name"] for r in other.table("images").orderBy("name").collect()] == ["a", "c"]


def test_tabular(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("x,y,z\nd1,cyprus,1\nd1,outliers,2\n,cyprus,3\nd2,cyprus,4\n")
    df = files.read_csv(spark, str(path), THRESHOLDS)
    assert df.columns == ["dataset", "scene", "thresholds"]
    assert [tuple(r) for r in tabular.group_count(df, "dataset").collect()] == [("d1", 2), ("d2", 1)]
    assert [tuple(r) for r in tabular.group_count(tabular.where_equal(df, "scene", "outliers"), "dataset").collect()] == [("d1", 1)]
    assert tabular.group_count(tabular.where_equal(df, "scene", "none"), "dataset").count() == 0
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "bad.csv"), THRESHOLDS)
    got = tabular.multimap(df, "scene", "thresholds", "thresholds").collect()
    assert {r["scene"]: r["values"] for r in got} == {"cyprus": ["1", "3", "4"], "outliers": ["2"]}


def test_ids_over_partitions(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    names = [(f"n{i:04d}",) for i in random.Random(1).sample(range(1000), 300)]
    df = frame(spark, names, "name string").repartition(7)
    want = {n: k for k, (n,) in enumerate(sorted(names), 5)}
    for rows in (300, tabular.ONE_WINDOW_ROWS + 1):
        assert {r["name"]: r["id"] for r in tabular.with_ids(df, "id", [F.col("name")], 5, rows).collect()} == want


def png(width, height, rgb):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress((b"\0" + bytes(rgb) * width) * height)) + chunk(b"IEND", b"")


def test_images_and_embeddings(spark, tmp_path):
    for n, (w, h) in {"a.png": (4, 2), "b.png": (3, 5)}.items():
        (tmp_path / n).write_bytes(png(w, h, (255, 51, 0)))
    rows = files.read_images(spark, str(tmp_path))
    assert {r["data"][:3] for r in rows.collect()} == {bytes([255, 51, 0])}
    vectors = [r["embedding"] for r in embed.extract_embeddings(rows, embed.MeanColour().to("cpu")).collect()]
    assert len(vectors) == 2 and all(np.allclose(v, [1, 0.2, 0] * 4) for v in vectors)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.png").write_bytes(png(7, 1, (0, 0, 0)))
    exif = b"Exif\0\0II" + struct.pack("<HI", 42, 8) + struct.pack("<H", 1) + struct.pack("<HHIHH", 0xA405, 3, 1, 35, 0) + b"\0" * 4
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, 480, 640, 3)
    (tmp_path / "c.jpg").write_bytes(jpeg)
    (tmp_path / "cut.jpg").write_bytes(jpeg[:20])
    (tmp_path / "note.txt").write_bytes(b"no image")
    heads = {r["name"]: (r["width"], r["height"], r["film_focal"]) for r in files.image_headers(spark, str(tmp_path)).collect()}
    assert heads == {"a.png": (4, 2, None), "b.png": (3, 5, None), "sub/a.png": (7, 1, None), "c.jpg": (640, 480, 35)}
    listing = files.listing(spark, str(tmp_path))
    ingest.check_files(frame(spark, [("a.png",)], "name string"), listing)
    with pytest.raises(OSError, match="zz"):
        ingest.check_files(frame(spark, [("zz.png",)], "name string"), listing)
    ingest.check_files(frame(spark, [("sub/a.png",), ("a.png",)], "name string"), listing, str(tmp_path))
    with pytest.raises(OSError, match="sub/b"):
        ingest.check_files(frame(spark, [("sub/b.png",)], "name string"), listing, f"file:{tmp_path}")
    with pytest.raises(ValueError):
        embed.to_batch("no image")
    with pytest.raises(RuntimeError):
        embed.NetVlad().setup()


def test_netvlad_with_stand_ins(monkeypatch):
    class Vector(np.ndarray):
        def to(self, device):
            return self

        def cpu(self):
            return self

        def numpy(self):
            return np.asarray(self)

    class Model:
        def __init__(self, conf):
            self.conf = conf

        def eval(self):
            return self

        to = lambda self, device: self

        def __call__(self, data):
            x = data["image"]
            assert x.shape == (1, 3, 2, 4) and x.dtype == np.float32
            return {"global_descriptor": x.mean(axis=(2, 3)) * self.conf["scale"]}

    torch = types.ModuleType("torch")
    torch.no_grad, torch.from_numpy = contextlib.nullcontext, lambda x: x.view(Vector)
    netvlad = types.ModuleType("hloc.extractors.netvlad")
    netvlad.NetVLAD = Model
    for name, module in {"torch": torch, "hloc": types.ModuleType("hloc"), "hloc.extractors": types.ModuleType("hloc.extractors"), "hloc.extractors.netvlad": netvlad}.items():
        monkeypatch.setitem(sys.modules, name, module)
    model = embed.NetVlad({"scale": 2.0}).to("cpu")
    model.setup()
    assert np.allclose(model.embed_image(np.full((2, 4, 3), (255, 51, 0), np.uint8)), [2.0, 0.4, 0.0])


def test_exif():
    def ifd(*entries, order="<"):
        return struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)) for t, k, v in entries) + b"\0" * 4

    for order, mark in (("<", b"II"), (">", b"MM")):
        head = b"Exif\0\0" + mark + struct.pack(order + "HI", 42, 8)
        assert files.film_focal(b"jpeg" + head + ifd((0xA405, 3, 28), order=order)) == 28
        assert files.film_focal(b"jpeg" + head + ifd((0x8769, 4, 26), order=order) + ifd((0xA405, 3, 50), order=order)) == 50
        assert files.film_focal(head + ifd((0x8769, 4, 8), order=order)) is None
    assert files.film_focal(b"nothing") is None and files.film_focal(b"Exif\0\0II") is None


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "s.db")
    sqlite.create_tables(path)
    sqlite.create_tables(path)
    sqlite.register(spark)
    rows = frame(spark, [(i, [[float(i), 2.0]]) for i in range(1, 40)], "image_id long, data array<array<float>>")
    out = rows.select("image_id", F.size("data").cast("long").alias("rows"), F.lit(2).cast("long").alias("cols"), blobs.to_blob(F.col("data"), "<f4").alias("data"))
    out.write.format("scene_sqlite").option("path", path).option("table", "keypoints").mode("append").save()
    db = sqlite3.connect(path)
    assert db.execute("SELECT count(*), sum(image_id) FROM keypoints").fetchone() == (39, 780)
    db.close()
    got = spark.read.format("scene_sqlite").option("path", path).option("table", "keypoints").load()
    some = got.where("image_id >= 38").select("image_id", blobs.from_blob(F.col("data"), "<f4", 2).alias("kps")).collect()
    assert sorted((r["image_id"], r["kps"]) for r in some) == [(38, [[38.0, 2.0]]), (39, [[39.0, 2.0]])]
    assert got.count() == 39
    with pytest.raises(Exception, match="UNIQUE"):  # all of a job's rows or none
        out.unionByName(out.withColumn("image_id", F.col("image_id") + 100)).write.format("scene_sqlite").option("path", path).option("table", "keypoints").mode("append").save()
    assert got.count() == 39 and [p.name for p in tmp_path.iterdir()] == ["s.db"]
    part = spark.read.format("scene_sqlite").option("path", path).option("table", "keypoints").option("low", 5).option("high", 7).load()
    assert sorted(r["image_id"] for r in part.collect()) == [5, 6, 7]


def test_cli(spark, tmp_path):
    (tmp_path / "img").mkdir()
    for n in ("a.png", "b.png"):
        (tmp_path / "img" / n).write_bytes(png(4, 2, (1, 2, 3)))
    frame(spark, [(n, [[1.0, 2.0]]) for n in ("a.png", "b.png")], KPS).write.parquet(str(tmp_path / "f" / "keypoints.parquet"))
    frame(spark, [("a.png", "b.png", [[0, 0]])], PAIRS).write.parquet(str(tmp_path / "f" / "matches.parquet"))
    args = [str(tmp_path / "f"), str(tmp_path / "img"), "--database-path", str(tmp_path / "db")]
    with pytest.raises(SystemExit):
        cli.main([*args, "--camera-model", "opencv"], spark)
    cli.main(args, spark)
    assert SceneStore(spark, str(tmp_path / "db")).table("matches").count() == 1
    with pytest.raises(SystemExit):
        cli.main(args, spark)


class FakeH5(dict):
    """What the reader uses of an HDF5 file: groups and datasets by name."""

    tree: dict = {}

    def __init__(self, path, mode):
        super().__init__({k: {n: np.array(v) for n, v in x.items()} if isinstance(x, dict) else np.array(x) for k, x in json.loads(open(path).read()).items()})

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def test_hdf5(spark, tmp_path, monkeypatch):
    (tmp_path / "h5py.py").write_text(f"import json\nimport numpy as np\n\n\n{inspect.getsource(FakeH5)}\nFile = FakeH5\n")
    with pytest.raises(RuntimeError):
        hdf5.keypoints(spark, "none")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
    (tmp_path / "keypoints.h5").write_text(json.dumps({"a.png": [[1.0, 2.0], [3.0, 4.0]], "b.png": [[5.0, 6.0]]}))
    (tmp_path / "matches.h5").write_text(json.dumps({"a.png": {"b.png": [[0, 0], [1, 0]]}}))
    kps = hdf5.keypoints(spark, str(tmp_path / "keypoints.h5"), 2)
    assert {r["name"]: r["kps"] for r in kps.collect()} == {"a.png": [[1.0, 2.0], [3.0, 4.0]], "b.png": [[5.0, 6.0]]}
    pairs = hdf5.matches(spark, str(tmp_path / "matches.h5"), 2)
    assert [tuple(r) for r in pairs.collect()] == [("a.png", "b.png", [[0, 0], [1, 0]])]
    sizes = frame(spark, [("a.png", 4, 4, None), ("b.png", 4, 4, None)], "name string, width int, height int, film_focal int")
    ingest.import_scene(spark, str(tmp_path / "s"), sizes, kps, pairs)
    assert [tuple(m) for m in SceneStore(spark, str(tmp_path / "s")).select_matches(2, 1)] == [(0, 0), (1, 0)]
    # one hot group in many partitions
    tree = {"hot": {f"o{k:04d}": [[k, k + 1]] for k in range(900)}, "b": {"x": [[1, 2], [3, 4]]}, "empty": {}, "c": {"y": [[5, 6]]}}
    (tmp_path / "m.h5").write_text(json.dumps(tree))
    got = hdf5.matches(spark, str(tmp_path / "m.h5"), 6)
    assert sorted(map(str, got.collect())) == sorted(map(str, frame(spark, [(a, b, m) for a, own in tree.items() for b, m in own.items()], got.schema).collect()))
    spread = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(spread) == 6 and max(spread) <= 151
    (tmp_path / "k.h5").write_text(json.dumps({f"i{k}": [[k, 0.5]] for k in range(20)}))
    kps = hdf5.keypoints(spark, str(tmp_path / "k.h5"), 3)
    assert {r["name"]: r["kps"] for r in kps.collect()} == {f"i{k}": [[float(k), 0.5]] for k in range(20)} and kps.rdd.getNumPartitions() == 3


def test_stream(spark, tmp_path, store):
    schema = "image_id1 long, image_id2 long, matches array<struct<idx1:long,idx2:long>>, n int"
    src = str(tmp_path / "in")
    store.add_matches(frame(spark, [(9, 8, [(3, 4)])], "image_id1 long, image_id2 long, matches array<struct<idx1:long,idx2:long>>"))

    def run():
        q = stream_matches(spark.readStream.schema(schema).parquet(src), store, ["n"], str(tmp_path / "check"), str(tmp_path / "again")).trigger(availableNow=True).start()
        q.awaitTermination()

    for rows in ([(2, 1, [(1, 2)], 0), (1, 2, [(5, 5)], 1), (None, 2, [], 0)], [(1, 2, [(7, 7)], 2), (3, 1, [], 3), (4, 5, None, 1), (8, 9, [(0, 0)], 0)]):
        frame(spark, rows, schema).coalesce(1).write.mode("append").parquet(src)
        run()
    assert [tuple(r) for r in store.select_matches(1, 2)] == [(2, 1)] and [tuple(r) for r in store.select_matches(8, 9)] == [(4, 3)]
    assert store.table("matches").count() == 4
    again = spark.read.parquet(str(tmp_path / "again")).orderBy("batch", "pair_id")
    assert [(r["batch"], r["pair_id"], r["n_dups"], r["known"]) for r in again.collect()] == [(0, MAX_ID + 2, 1, False), (1, MAX_ID + 2, 0, True), (1, 8 * MAX_ID + 9, 0, True)]
    # a batch that was written, but whose end wasn't noted, comes again
    commits = sorted((tmp_path / "check" / "commits").glob("[0-9]*"))
    for p in (tmp_path / "check" / "commits").glob(f"*{commits[-1].name}*"):
        p.unlink()
    before = store._state()["version"]
    run()
    assert store._state()["version"] == before and store.table("matches").count() == 4
    frame(spark, [(1, 2, [(7, 7)], 2), (6, 7, [(1, 1)], 0)], schema).coalesce(1).write.mode("append").parquet(src)
    run()  # late duplicates are told from state
    assert store.table("matches").count() == 5 and [tuple(r) for r in store.select_matches(1, 2)] == [(2, 1)]


def test_frustum(spark):
    from skarn.functions import geometry as g

    rect = F.array(*(g.point(F.lit(x), F.lit(y), F.lit(1.0)) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))))
    df = frame(spark, [(1,)], "id int")
    edges = scene.frustum_edges(df, ["id"], g.point(F.lit(9.0), F.lit(9.0), F.lit(9.0)), rect, scale=2.0).orderBy("edge").collect()
    assert [(r["x0"], r["x1"], r["z1"]) for r in edges] == [(9.0, 0.0, 2.0), (9.0, 2.0, 2.0), (9.0, 2.0, 2.0), (9.0, 0.0, 2.0)]
    fig = figure.draw(scene.frustum_faces(df, ["id"], rect).unionByName(scene.frustum_faces(frame(spark, [(2,)], "id int"), ["id"], rect, scale=2.0)))
    assert [(t["type"], t["x"], t["y"], t["i"], t["j"], t["k"], t["opacity"]) for t in fig["data"]] == [("mesh3d", [0.0, s, s, 0.0], [0.0, 0.0, s, s], [0, 0], [1, 2], [2, 3], 0.5) for s in (1.0, 2.0)]
    assert fig["layout"]["legend"]["x"] == 0.1 and fig["layout"]["scene"]["xaxis"]["visible"] is False
    short = scene.rays(df, ["id"], g.point(F.lit(0), F.lit(0), F.lit(0)), rect, colours=["red", "blue"]).collect()
    assert [r["rgb"] for r in short] == ["red", "blue"]
    axes = scene.axes(df, ["id"], g.point(F.lit(0), F.lit(0), F.lit(0)), [g.point(F.lit(1), F.lit(0), F.lit(0))] * 3, options={"color": "x", "yaxis:name": "up", "width": 3}).collect()
    assert [(r["axis"], r["color"]) for r in axes] == [("xaxis", "x"), ("up", "x"), ("zaxis", "x")]


def test_constants_are_not_sorted(spark, tmp_path, monkeypatch):
    kind, sorted_columns = type(spark.range(1)), []
    own = kind.sortWithinPartitions
    monkeypatch.setattr(kind, "sortWithinPartitions", lambda df, *by, **kw: sorted_columns.append(df.columns) or own(df, *by, **kw))
    store = SceneStore(spark, str(tmp_path / "s"))
    store.create_tables()
    store.add_two_view_geometries(spark.createDataFrame([(5, 2, [(1, 9)], [2.0] * 9)], "image_id1 long, image_id2 long, matches array<struct<idx1:long,idx2:long>>, E array<double>"))
    store.add_images(spark.createDataFrame([("a", 1, 0.5)], "name string, camera_id long, prior_tx double"))
    views, images = sorted_columns
    assert "E" in views and not {"F", "H", "config"} & set(views)
    assert "prior_tx" in images and not {"prior_qw", "prior_tz"} & set(images)
    r = store.table("two_view_geometries").first()
    assert (r["config"], r["E"], r["F"], r["H"]) == (2, [2.0] * 9, IDENTITY, IDENTITY)
    r = store.table("images").first()
    assert (r["prior_tx"], r["prior_qw"], r["prior_tz"]) == (0.5, 0.0, 0.0)
