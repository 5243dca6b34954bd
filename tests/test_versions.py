import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.operators import versions
from skarn.operators.store import SceneStore
from skarn.operators.versions import ConstraintError, VersionedTables

SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType(), False), T.StructField("x", T.DoubleType())])


def rows(spark, ids, x=0.0, prefix="n"):
    return spark.createDataFrame([(i, f"{prefix}{i}", float(x)) for i in ids], SCHEMA)


@pytest.fixture
def tables(spark, tmp_path):
    t = VersionedTables(spark, str(tmp_path / "t"), {"t": SCHEMA}, {"t": ["id", "name"]})
    t.create_tables()
    return t


def again(t):
    """Another writer of the same tables."""
    return VersionedTables(t.spark, t.root, t.schemas, t.unique)


def live(t):
    return {r["id"]: r["x"] for r in t.table("t").collect()}


def stored(t):
    return {p: p.stat().st_size for p in Path(t.root).rglob("*") if p.is_file()}


def test_delete_writes_keys_not_tables(spark, tables):
    tables.append("t", spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("name"), F.rand(1).alias("x")))
    before = stored(tables)
    tables.delete("t", [17])
    new = {p: n for p, n in stored(tables).items() if p not in before}
    assert sum(new.values()) < 4096 and sum(n for p, n in before.items() if p.suffix == ".parquet") > 1_000_000
    tables.delete("t", spark.range(100, 59_000, 2).toDF("id"))  # too many for the manifest
    assert sum(n for p, n in stored(tables).items() if p not in before and "deletes-" in str(p)) < 300_000
    assert tables.table("t").count() == 60_000 - 1 - 29_450
    assert tables.rows_by_key("t", [17, 18, 100, 101, 59_999]).count() == 3


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_deletes_by_join(spark, tables, monkeypatch, broadcast):
    monkeypatch.setattr(versions, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(versions, "INLINE_KEYS", 3)
    tables.append("t", rows(spark, range(50)))
    tables.delete("t", spark.createDataFrame([(k,) for k in (1, 2, 2, 3, None, 400)], "id long"))
    tables.append("t", rows(spark, [2, 60], x=5))  # comes back after it was deleted
    tables.replace("t", rows(spark, [4, 5, 6, 7, 70], x=7, prefix="m"))
    tables.delete("t", range(40, 48))
    want = {k: 0.0 for k in range(50) if k not in (1, 2, 3, *range(40, 48))} | {2: 5.0, 60: 5.0} | dict.fromkeys([4, 5, 6, 7, 70], 7.0)
    assert live(tables) == want
    assert {r["id"]: r["x"] for r in tables.rows_by_key("t", [1, 2, 4, 41, 49, 70]).collect()} == {2: 5.0, 4: 7.0, 49: 0.0, 70: 7.0}
    tables.compact("t")
    assert live(tables) == want and not tables._last("t")["deletes"] and len(tables._last("t")["folders"]) == 1
    tables.vacuum()
    assert live(again(tables)) == want and not [p for p in stored(tables) if "deletes-" in str(p)]


@pytest.mark.parametrize("listed", [100, 2])
def test_reads_by_key_open_few_files(spark, tables, monkeypatch, listed):
    monkeypatch.setattr(versions, "FILE_ROWS", 40)
    monkeypatch.setattr(versions, "INLINE_FILES", listed)
    tables.append("t", spark.range(3000).select((F.col("id") * 7 % 3000).alias("id"), F.concat(F.lit("n"), F.col("id")).alias("name"), F.lit(1.0).alias("x")))
    tables.append("t", rows(spark, range(5000, 5010)))
    every = tables.table("t").inputFiles()
    assert len(every) >= 75 and ("stats" in tables._last("t")["folders"][0]) == (listed == 2)
    for asked, files in (([1234], 1), ([5003], 1), ([0, 2999, 5009], 3), ([4000], 0)):
        found = tables.rows_by_key("t", asked)
        assert sorted(r["id"] for r in found.collect()) == [k for k in asked if k != 4000] and len(found.inputFiles()) == files


def test_store_opens_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FILE_ROWS", 5)
    store = SceneStore(spark, str(tmp_path / "s"))
    store.create_tables()
    store.add_keypoints(spark.range(1, 101).select(F.col("id").alias("image_id"), F.array(F.array(F.lit(1.0), F.col("id").cast("double"))).alias("data")))
    assert len(store.table("keypoints").inputFiles()) >= 20 and len(store.rows_of("keypoints", 42).inputFiles()) == 1
    assert store.select_keypoints(42) == [[1.0, 42.0]]
    store.delete_keypoints(42)
    assert store.select_keypoints(42) is None and store.select_keypoints(43) == [[1.0, 43.0]]


def test_append_of_new_keys_reads_no_old_file(spark, tables):
    names = F.concat(F.lit("name"), F.col("id")).alias("name")
    tables.append("t", spark.range(0, 20_000, 2).select("id", names, F.lit(0.0).alias("x")))
    folder = Path(tables.root, "t", tables._last("t")["folders"][0]["name"])
    away = folder.with_name("away")
    shutil.move(folder, away)
    some = spark.createDataFrame([(k, f"other{k}", 1.0) for k in range(1, 500, 2)], SCHEMA)
    # of 250 new keys in the same range hardly any are suspected
    filters = spark.read.schema("block long, words array<long>").parquet(f"{tables.root}/t/{tables._last('t')['folders'][0]['blooms']['id']['name']}")
    blocks = tables._last("t")["folders"][0]["blooms"]["id"]["blocks"]
    doubtful = [r["id"] for r in versions.suspects(some, "id", filters, blocks).collect()]
    clear = some.where(~F.col("id").isin(doubtful or [-1]))
    seen = versions.suspects(clear, "name", spark.read.schema("block long, words array<long>").parquet(f"{tables.root}/t/{tables._last('t')['folders'][0]['blooms']['name']['name']}"), blocks)
    clear = clear.join(seen, "name", "left_anti").select(SCHEMA.names)
    assert len(doubtful) < 15 and clear.count() > 220
    tables.append("t", clear)
    shutil.move(away, folder)
    assert tables.table("t").count() == 10_000 + clear.count()
    for bad in ((4, "new"), (9001, "name44")):
        with pytest.raises(ConstraintError, match="exists"):
            tables.append("t", spark.createDataFrame([(*bad, 0.0)], SCHEMA))
    every = versions.suspects(spark.range(0, 20_000, 2), "id", filters, blocks)
    assert every.count() == 10_000  # none that was put in is missing
    assert versions.suspects(spark.range(10**6, 10**6 + 10_000), "id", filters, blocks).count() < 300


def test_keys_of_many_folders(spark, tables, monkeypatch):
    monkeypatch.setattr(versions, "INLINE_KEYS", 4)
    for k in range(3):
        tables.append("t", rows(spark, range(k, 60, 6)))
    tables.append("t", rows(spark, [3, 9]))
    for ids in ([8], range(3, 60, 6), [61, 9]):
        with pytest.raises(ConstraintError, match="exists"):
            tables.append("t", rows(spark, ids, prefix="other"))
    with pytest.raises(ConstraintError, match="repeats"):
        tables.append("t", rows(spark, [100] * 2))
    with pytest.raises(ConstraintError, match="repeats"):
        tables.append("t", spark.createDataFrame([(k, "same", 0.0) for k in range(200, 210)], SCHEMA))
    tables.delete("t", [8])
    tables.append("t", rows(spark, [8]))


def test_failed_writes_leave_nothing(spark, tables):
    tables.append("t", rows(spark, [1]))
    before = stored(tables)
    for bad in (rows(spark, [1]), rows(spark, [5, 5])):
        with pytest.raises(ConstraintError):
            tables.append("t", bad)
    with pytest.raises(RuntimeError), tables.transaction():
        tables.append("t", rows(spark, [7]))
        tables.delete("t", spark.range(2000).toDF("id"))
        raise RuntimeError
    tables.append("t", rows(spark, []))
    assert {p for p in stored(tables) if "manifests" not in str(p)} == {p for p in before if "manifests" not in str(p)} and live(tables) == {1: 0.0}


def test_two_writers(spark, tables):
    tables.append("t", rows(spark, [1, 2]))
    other = again(tables)
    with tables.transaction():  # both succeed
        tables.append("t", rows(spark, [3]))
        tables.delete("t", [2])
        other.append("t", rows(spark, [4]))
        other.append("t", rows(spark, [5]))
    assert live(other) == dict.fromkeys([1, 3, 4, 5], 0.0)
    with pytest.raises(ConstraintError, match="exists"), tables.transaction():
        tables.append("t", rows(spark, [6, 7]))
        other.append("t", rows(spark, [7]))
    assert live(tables) == dict.fromkeys([1, 3, 4, 5, 7], 0.0)
    with tables.transaction():  # what one replaces goes, also where the other adds it meanwhile
        tables.replace("t", rows(spark, [1, 8], x=2, prefix="m"))
        other.append("t", rows(spark, [8]))
    assert live(other) == dict.fromkeys([3, 4, 5, 7], 0.0) | {1: 2.0, 8: 2.0}
    with tables.transaction():  # a table that is folded while rows of it are deleted
        tables.append("t", rows(spark, [9]))
        tables.compact("t")
        other.delete("t", [3])
    assert live(other) == dict.fromkeys([4, 5, 7, 9], 0.0) | {1: 2.0, 8: 2.0}


def test_against_a_dict(spark, tables, monkeypatch):
    monkeypatch.setattr(versions, "INLINE_KEYS", 5)
    monkeypatch.setattr(versions, "SMALL_FOLDERS", 3)
    monkeypatch.setattr(versions, "DELETES", 3)
    monkeypatch.setattr(versions, "FILE_ROWS", 4)
    rng, want = random.Random(5), {}
    for step in range(16):
        some = rng.sample(range(60), rng.choice([1, 3, 12]))
        kind = rng.choice(["append", "append", "delete", "replace"])
        if kind == "append":
            some = [k for k in some if k not in want]
            tables.append("t", rows(spark, some, step))
            want |= dict.fromkeys(some, float(step))
        elif kind == "replace":
            tables.replace("t", rows(spark, some, step))
            want |= dict.fromkeys(some, float(step))
        else:
            tables.delete("t", some)
            want = {k: x for k, x in want.items() if k not in some}
        assert live(tables) == want
    assert {r["id"]: r["x"] for r in tables.rows_by_key("t", range(30)).collect()} == {k: x for k, x in want.items() if k < 30}
    tables.vacuum()
    assert live(again(tables)) == want and len(list(Path(tables.root, "manifests").glob("*.json"))) == 1


def test_numbered_writes_count_once(spark, tables):
    for number, ids, want in ((0, [1], True), (0, [2], False), (2, [3], True), (1, [4], False)):
        with tables.transaction("stream", number) as new:
            assert new == want
            tables.append("t", rows(spark, ids))
    with tables.transaction("other", 0):
        tables.append("t", rows(spark, [5]))
    files = set(stored(tables))
    with tables.transaction("stream", 3):  # a second attempt at the same, as after a lost driver
        tables.append("t", rows(spark, [6]))
        with again(tables).transaction("stream", 3) as new:
            assert new
    assert live(tables) == dict.fromkeys([1, 3, 5], 0.0)
    assert {p for p in stored(tables) if "manifests" not in str(p)} == {p for p in files if "manifests" not in str(p)}


def test_a_manifest_whose_writer_died(spark, tables, monkeypatch):
    monkeypatch.setattr(versions, "WAIT_S", 0.01)
    tables.append("t", rows(spark, [1]))
    version = tables._state()["version"]
    Path(tables.root, "manifests", f"{version + 1:010d}.json").write_text('{"version": 2, "tab')
    other = again(tables)
    assert live(other) == {1: 0.0}
    other.append("t", rows(spark, [2]))
    assert live(tables) == {1: 0.0, 2: 0.0} and tables._state()["version"] == version + 2
