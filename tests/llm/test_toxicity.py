import math
import random
import zlib
from collections import Counter

from skarn.llm import toxicity

BAD = ["idiot", "scum", "worthless"]


def corpus(n=600):
    rng = random.Random(6)
    plain = ["".join(rng.choice("abdefghinorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.2)
        for _ in range(2 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(BAD).upper() if rng.random() < 0.5 else rng.choice(BAD))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(9000, None, "en"), (9001, "", "en")], "doc_id long, text string, score string")
    # labels of the held-out fold are wrong on purpose: nothing may be learnt from them
    labels = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == len(rows) + 2
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert got[9000]["score"] == got[9001]["score"] < 0.5


def test_degenerate_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 0), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(r["predicted"] == 0 for r in toxicity.classify(docs, one).collect())
    assert toxicity.classify(docs.limit(0), none).count() == 0


def slow_buckets(text):
    """Buckets of a text's n-grams, character by character."""
    c = [32, *map(ord, " ".join((text or "").lower().split())), 32]
    out, full = set(), (1 << 64) - 1
    for n in toxicity.LENGTHS:
        for at in range(len(c) - n + 1):
            h = sum(c[at + k] * toxicity._PRIMES[k] for k in range(n)) & full
            out.add(((h ^ h >> 29) * (0xBF58476D1CE4E5B9 + 2 * n) & full) >> (64 - toxicity.BUCKET_BITS))
    return out


def slow_score(text, model):
    x = model.intercept + sum(float(model.weight[b]) for b in slow_buckets(text))
    return 1 / (1 + math.exp(-max(-500, min(500, x))))


def test_ratios_and_scores_against_plain_counts(spark):
    from pyspark.sql import functions as F

    rows = [*corpus(120), (500, None, 0), (501, "", 1), (502, "É\u0130  x\ny", 0), (503, "long " * 40_000, 0)]
    train = spark.createDataFrame([(t or "", float(y)) for _, t, y in rows], "text string, label double").repartition(3)
    ratio, held = toxicity.log_count_ratios(train, "text", "label")
    count = [Counter(), Counter()]
    for _, t, y in rows:
        count[y].update(slow_buckets(t))
    some = [b for b in count[0] | count[1] if count[0][b] + count[1][b] >= toxicity.LEAST_DOCUMENTS]
    size = 1 << toxicity.BUCKET_BITS
    total = [sum(c[b] for b in some) + toxicity.SMOOTHING * size for c in count]
    assert held.sum() == sum(c[b] for c in count for b in some)
    for b in some:
        want = math.log((count[1][b] + toxicity.SMOOTHING) / total[1]) - math.log((count[0][b] + toxicity.SMOOTHING) / total[0])
        assert abs(ratio[b] - want) < 1e-9
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    got = spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", toxicity.score(F.col("text"), model).alias("p"))
    texts = {i: t for i, t, _ in rows}
    assert all(abs(r["p"] - slow_score(texts[r["doc_id"]], model)) < 1e-5 for r in got.collect())
