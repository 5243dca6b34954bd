import hashlib
import math
import random
import re
import zlib

import pytest

from skarn.llm import importance
from skarn.llm.common import table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, longest):
    w = words(text)
    return [" ".join(w[i : i + k]) for i in range(len(w)) for k in range(1, longest + 1) if i + k <= len(w)]


def brute(docs, target, longest=1):
    """(id, n_features, weight, score, rank) for (id, text) rows, by the definition."""
    def bucket(f):
        return zlib.crc32(f.encode()) % 10_000

    s, t = [0] * 10_000, [0] * 10_000
    for _, text in docs:
        for f in runs(text, longest):
            s[bucket(f)] += 1
    for text in target:
        for f in runs(text, longest):
            t[bucket(f)] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    rows = []
    for number, text in docs:
        found = [gain[bucket(f)] for f in runs(text, longest)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if number is None else number}".encode()).hexdigest()[:8], 16)
        rows.append([number, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * 10 // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def some_texts(n=300):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé9Z") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    out = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) + rng.choice(["", ".", " \n", "—x"]) for _ in range(n)]
    out += ["", "...", "one", " ".join(rng.choices(vocabulary, k=30_000)), "x" * 70_000, "ÀÉ٣ 日本 a-b_c"]
    return out, [" ".join(rng.choices(vocabulary[:80], k=30)) for _ in range(20)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("longest", [1, 3])
def test_against_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(importance, "CHUNK_BYTES", 200)
    texts, target = some_texts()
    docs = list(enumerate(texts))
    rows = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, rank int").repartition(5)
    aims = spark.createDataFrame([(x,) for x in [*target, None, ""]], "text string")
    got = importance.resample(rows, aims, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute(docs, target, longest), key=key)


def test_nulls_and_repeats(spark):
    texts, target = some_texts(60)
    docs = [(None, None), (None, texts[0]), (5, texts[1]), (5, texts[1]), (5, texts[2]), *((7, texts[3] * 40) for _ in range(50)), *enumerate(texts, 100)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = importance.resample(rows, spark.createDataFrame([(x,) for x in target], "text string")).collect()
    want = brute(docs, target)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted((r[:4] for r in want), key=key)
    assert sorted(r["rank"] for r in got if r["rank"]) == sorted(r[4] for r in want if r[4])
    # equal rows are ranked one after the other
    assert sorted(map(key, ((r["doc_id"], r["rank"]) for r in got))) == sorted(map(key, ((r[0], r[4]) for r in want)))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    aims = spark.createDataFrame([], "text string")
    assert importance.resample(docs, aims).count() == 0
    one = spark.createDataFrame([(1, "a " * 30), (2, "")], "doc_id long, text string")
    assert sorted(r["rank"] or 0 for r in importance.resample(one, aims).collect()) == [0, 0]


def test_chunks_own_their_words():
    rng = random.Random(5)
    for _ in range(300):
        raw = "".join(rng.choice("ab1é .,\n") for _ in range(rng.randint(0, 80))).encode()
        for longest in (1, 2, 4):
            parts = list(importance.chunks(raw, longest, rng.randint(1, 20)))
            assert b"".join(own for own, _ in parts) == raw
            found = [b for part in parts for b in importance.features(*part, longest, {}, 10_000)[1]]
            w = words(raw.decode())
            want = [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for i in range(len(w)) for k in range(1, longest + 1) if i + k <= len(w)]
            assert sorted(found) == sorted(want)


def test_given_documents(spark):
    docs, target = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    got = sorted((tuple(r) for r in importance.resample(docs, target).collect()), key=key)
    assert got == sorted(brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()]), key=key)
