import random

import pytest
from pyspark.sql import functions as F

from skarn.operators import ingest, tabular


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_hot_names(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ingest, "BROADCAST_NAMES", broadcast)
    monkeypatch.setattr(ingest, "HOT_NAMES", 4)
    rng = random.Random(1)
    names = {f"n{k}": k + 1 for k in range(40)}
    rows = [(rng.choice(["n0", "n0", "n1", *names, "unknown", None]), rng.choice(["n0", "n2", *names, None, "lost"]), k) for k in range(600)] + [("n0", "n2", 7)] * 300
    matches = spark.createDataFrame(rows, "name1 string, name2 string, x int")
    got = ingest.resolved(matches, spark.createDataFrame(list(names.items()), "name string, image_id long"))
    assert sorted(map(str, (tuple(r) for r in got.select("name1", "name2", "x", "image_id1", "image_id2").collect()))) == sorted(str((a, b, x, names.get(a), names.get(b))) for a, b, x in rows)
    assert set(got.columns) == {"name1", "name2", "x", "image_id1", "image_id2"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("Aggregate" in plan) == (broadcast == 0)


def test_hot_rows_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(ingest, "BROADCAST_NAMES", 0)
    pairs = spark.range(20_000).select(F.lit("hot").alias("name1"), F.concat(F.lit("n"), F.col("id")).alias("name2"))
    names = spark.range(20_000).select(F.concat(F.lit("n"), F.col("id")).alias("name"), F.col("id").alias("image_id")).unionByName(spark.createDataFrame([("hot", -1)], "name string, image_id long"))
    got = ingest.resolved(pairs, names)
    assert got.where("image_id1 = -1 and name2 = concat('n', image_id2)").count() == 20_000


def test_pairs_of_names_are_shuffled_by_each_name_once(spark, monkeypatch):
    monkeypatch.setattr(ingest, "BROADCAST_NAMES", 0)
    monkeypatch.setattr(ingest, "HOT_NAMES", 4)
    options = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        rows = [("n0", "n1")] * 2000 + [(None, "lost")] * 2000 + [(f"n{k}", f"n{k + 1}") for k in range(40)]
        names = {f"n{k}": k for k in range(40)}
        got = ingest.resolved(spark.createDataFrame(rows, "name1 string, name2 string").repartition(8), spark.createDataFrame(list(names.items()), "name string, image_id long"))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((a, b, names.get(a), names.get(b))) for a, b in rows)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # each lookup's rows and names, and for the broadcast of hot names their count, their names and all names
        assert plan.count("Exchange hashpartitioning") <= 2 * (2 + 3)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < len(rows) / 2  # hot, unknown and null names don't meet in one task
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize(("size", "parts"), [(7, "5"), (1000, "16"), (1, "3")])
def test_multimap_of_a_hot_key(spark, size, parts):
    rng = random.Random(2)
    order = rng.sample(range(10_000), 3000)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", "c", None]), o, f"v{o}") for o in order]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = tabular.multimap_chunks(spark.createDataFrame(rows, "key string, o int, v string").repartition(4), "key", "v", ["o"], size).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        want.setdefault(k, []).append(v)
    assert max(len(r["values"]) for r in got) <= size
    assert {(r["key"], r["chunk"]): r["values"] for r in got} == {(k, c // size): v[c : c + size] for k, v in want.items() for c in range(0, len(v), size)}


def test_multimap_chunks_of_nothing(spark):
    assert tabular.multimap_chunks(spark.createDataFrame([], "key string, o int, v string"), "key", "v", ["o"]).count() == 0
