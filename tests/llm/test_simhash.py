import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from skarn.llm import simhash
from skarn.llm.components import components


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, threshold=4):
    """Least id that links reach, for ids in order."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= threshold).tolist():
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_anchors_cover():
    # whatever differs by one bit shares the one's home among the other's anchors, in each segment
    rng = random.Random(2)

    def syndrome(x):
        s = 0
        for i in range(simhash.CODE_BITS):
            s ^= (i + 1) * (x >> i & 1)
        return s

    for _, width in simhash.SEGMENTS:
        for _ in range(300):
            x = rng.getrandbits(width)
            home = x ^ simhash.anchor_masks(width, syndrome(x))[0]
            assert syndrome(home) == 0 and bin(home ^ x).count("1") <= 1
            for y in [x] + [x ^ 1 << b for b in range(width)]:
                assert home in {y ^ m for m in simhash.anchor_masks(width, syndrome(y))}


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "é", "x", "DELTA"]
    texts = [None, "", " \t\n", "one", "one two three four", "A b\u00a0c d e"]
    for _ in range(60):
        base = [rng.choice(words) + str(rng.randint(0, 30)) for _ in range(rng.choice([3, 20, 200]))]
        texts.append(" ".join(base))
        texts.append(" ".join(base))
        base[rng.randrange(len(base))] = "edit"
        texts.append("  ".join(base))
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "fp": "clash", "component_id": 0}))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs.repartition(5)).collect()}
    fps = [slow(t) for t in texts]
    assert [int(got[i]["fingerprint"], 16) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == brute(fps)


def test_close_fingerprints_in_a_large_group(spark, monkeypatch):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(near)
    monkeypatch.setattr(simhash, "HOT_HOMES", 20)  # hot anchors are split among tasks
    rows = spark.createDataFrame([(i, int(np.uint64(x).view(np.int64))) for i, x in enumerate(fps)], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(rows).collect()}
    assert [got[i] for i in range(len(fps))] == brute(fps)


def test_masks_leave_no_pair_out():
    rng = random.Random(2)
    for segment in range(3):
        for equal in (1, 2, 3):
            masks = [m & (1 << 64) - 1 for m in simhash.block_masks(segment, equal)]
            low, width = simhash.SEGMENTS[segment]
            assert all(not m & ((1 << width) - 1) << low for m in masks)
            for _ in range(200):
                flips = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4)))
                assert any(not flips & m for m in masks)


@pytest.mark.parametrize("levels", [(1, 1 << 9, 1 << 15), (1, 2, 4), (0, 0, 0)])
def test_hot_anchors_are_told_apart(spark, monkeypatch, levels):
    monkeypatch.setattr(simhash, "HOT_HOMES", 3)
    monkeypatch.setattr(simhash, "BLOCK_LEVELS", levels)
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = [rng.getrandbits(64) for _ in range(100)]
    fps += [base ^ sum(1 << i for i in rng.sample(range(21), rng.randint(0, 2))) ^ rng.getrandbits(20) << 42 for _ in range(150)]  # one anchor's
    fps += [f ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 5))) for f in rng.choices(fps, k=150)]
    fps = sorted(set(fps))
    rows = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "doc_id long, fp long").repartition(3)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(rows).collect()}
    assert [got[k] for k in range(len(fps))] == [find(k) for k in range(len(fps))]


def test_keep_one(spark):
    docs = spark.createDataFrame([(3, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, None), (4, ""), (None, "other words")], "doc_id long, text string")
    assert sorted((r["doc_id"] for r in simhash.keep_one(docs).collect()), key=str) == [1, 2, None]


def test_keep_one_where_ids_are_null_or_repeat(spark):
    one, two, three, four = "a b c d e", "quite another text of seven words", "the third of them is here", "a fourth one that all lack"
    rows = [(None, one, "x"), (None, two, "x"), (None, two, "y"), (5, one, "x"), (1, three, "x"), (5, four, "x"), (7, three, None), (7, "the last text alone", None)]
    docs = spark.createDataFrame([*rows, (1, three, "x")], "doc_id long, text string, kind string")
    got = simhash.keep_one(docs.repartition(3))
    assert got.columns == docs.columns
    # one row for each text: of the least id, null last
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(None, two), (5, one), (1, three), (5, four), (7, "the last text alone")], key=str)


def test_components_of_a_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    got = {r["v"]: r["m"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
