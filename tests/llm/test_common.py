import json

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skarn.llm import common, huffman
from skarn.sources import hadoop


def test_slices_are_bounded():
    texts = ["", None, "a" * 10, "b" * 25, "é" * 6, "c", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    got = list(common.slices(iter([batch, batch.slice(0, 0), batch.slice(3)]), 1, 3, 20))
    assert [t for b in got for t in b.column(1).to_pylist()] == texts + texts[3:]
    assert all(b.num_rows <= 3 and (b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 20) for b in got)
    assert [p.to_pylist() for p in common.pieces(batch.column(1), 100, 1 << 20)] == [texts]


def test_ranges_of_ids(spark):
    ids = [*range(1000), 10**15, -(10**15), *[7] * 50, None]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").repartition(3)
    got = rows.select("i", common.id_buckets(rows, "i").alias("b")).collect()
    assert [r["b"] for r in got if r["i"] is None] == [None]
    own = sorted((r["i"], r["b"]) for r in got if r["i"] is not None)
    assert [b for _, b in own] == sorted(b for _, b in own)  # ascending with the ids
    sizes = {}
    for _, b in own:
        sizes[b] = sizes.get(b, 0) + 1
    # a far-off id doesn't put all others into one range; one id is always in one
    assert len(sizes) >= 14 and max(sizes.values()) <= 50 + 2 * len(ids) // 16
    one = rows.where("i is null")
    assert one.select(common.id_buckets(one, "i").alias("b")).first()["b"] is None


def test_hot_keys_and_others_join_alike(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = spark.createDataFrame([(1, i) for i in range(60)] + [(k, k) for k in range(2, 30)], "k int, v int")
    keys = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m")).where("k <> 9")
    got = sorted(map(tuple, common.joined_by_key(rows, keys, ["k"]).select("k", "v", "m").collect()))
    assert got == sorted([(1, i, 59) for i in range(60)] + [(k, k, k) for k in range(2, 30) if k != 9])


def test_small_tables_make_few_files(spark):
    df = common.written(spark.range(100).repartition(40), "few", rows=100)
    assert len(df.inputFiles()) <= common.LEAST_FILES and df.count() == 100
    common.removed(spark, df)
    with pytest.raises(Exception, match="exist|PATH_NOT_FOUND|not found"):
        df.count()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "local-cluster[2,1,512]"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="checkpoint"):
        hadoop.shared_dir(Session())


def test_rules_of_a_tokenizer_are_read():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        rule = json.load(f)
    assert huffman._rules(rule) == (True, True)
    split = rule["pre_tokenizer"]["pretokenizers"][0]
    for pattern in (split["pattern"]["Regex"] + r"|\s+(?!\S)", split["pattern"]["Regex"] + "| ?[a-z]+"):
        split["pattern"]["Regex"], kept = pattern, split["pattern"]["Regex"]
        assert huffman._rules(rule) == (False, False)
        split["pattern"]["Regex"] = kept
    split["behavior"] = "Isolated"
    assert huffman._rules(rule) == (False, False)
    assert huffman._rules({"normalizer": None, "pre_tokenizer": None}) == (False, False)


def test_a_hot_id_has_many_buckets(spark):
    ids = [*range(0, 2000, 2), *[501] * 3000, *[700] * 1500]
    rows = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "i long, k int").repartition(3)
    got = sorted((r["b"], r["i"]) for r in rows.select("i", common.split_buckets(rows, "i", F.col("k")).alias("b")).collect())
    assert [i for _, i in got] == sorted(ids)  # ascending with the ids
    sizes, of = {}, {}
    for b, i in got:
        sizes[b] = sizes.get(b, 0) + 1
        of.setdefault(i, set()).add(b)
    assert len(of[501]) >= 6 and len(of[700]) >= 3 and max(sizes.values()) < len(ids) / 8
    none = rows.where("i is null")
    assert none.select(common.split_buckets(none, "i", F.col("k"))).count() == 0
