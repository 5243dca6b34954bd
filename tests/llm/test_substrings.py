import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from skarn.llm import common, substrings
from skarn.llm.suffixes import suffix_array


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(1500):
        s = [rng.randint(0, rng.choice([0, 1, 2, 25])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(texts, length=substrings.LENGTH):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(raw):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((d, p))
    cut = [np.zeros(len(b) + 1, bool) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                cut[d][p : p + length] = True
    return [(len(b), int(c.sum()), int((~c[1:] & c[:-1]).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~c[:-1]])).hexdigest()) for b, c in zip(raw, cut, strict=True)]


def texts():
    rng = random.Random(2)

    def some(n):
        return "".join(rng.choice("abcdefghij é\n") for _ in range(n))

    shared, line = some(900), some(250)
    out = [None, "", "short", shared, "x" + shared[:399], shared[:400] + "y", "ab" * 700, "é" * 450]
    for _ in range(12):
        edited = list(shared)
        edited[rng.randrange(900)] = "Z"
        out.append(some(rng.randint(0, 300)) + "".join(edited) + some(rng.randint(0, 300)))
    out += [some(200) + line + some(200) for _ in range(6)]  # shorter than what counts
    out += [out[9], out[9]]
    return out


def check(spark):
    t = texts()
    docs = spark.createDataFrame([(i, x, 5) for i, x in enumerate(t)], "doc_id long, text string, first int").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.digests(docs).collect()}
    assert [got[i] for i in range(len(t))] == brute(t)


def test_against_brute_force(spark):
    check(spark)


def test_many_contexts_go_by_hashes(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SORTED_CONTEXTS", 3)
    check(spark)


def test_no_key_is_hot(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 1)
    monkeypatch.setattr(substrings, "SORTED_CONTEXTS", 3)
    check(spark)


def test_blocks(monkeypatch):
    raw = (b"abcdefg" * 3 + bytes(random.Random(3).randbytes(3000))) * 2
    whole = list(substrings._runs(raw))
    covered = sorted(p for _, a, b in whole for p in range(a, b + 1))
    assert covered == list(range(len(raw) - substrings.LENGTH + 1))
    monkeypatch.setattr(substrings, "BLOCK", 700)
    assert sorted((g, p) for g, a, b in substrings._runs(raw) for p in range(a, b + 1)) == sorted((g, p) for g, a, b in whole for p in range(a, b + 1))


def by_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in substrings.digests(docs).collect()), key=str)
    return got, sorted(((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows]), strict=True)), key=str)


def test_ids_tell_nothing(spark, monkeypatch):
    rng = random.Random(9)
    some = ["".join(rng.choices("abcdefgh ", k=900)) for _ in range(8)]
    near = some[0][:500] + "X" + some[0][500:]
    rows = [(None, t) for t in some] + [(None, some[1]), (3, some[2]), (3, some[3]), (3, near), (4, some[4] + some[4]), (None, "z" * 5000), (5, None), (5, "")]
    for contexts in (48, 1):
        monkeypatch.setattr(substrings, "SORTED_CONTEXTS", contexts)
        got, want = by_brute_force(spark, rows)
        assert got == want


def test_texts_whose_short_hashes_collide(spark):
    """Two texts of no id whose 32-bit hashes are equal: what is cut from one stays in the other."""
    rows = spark.range(200_000).select(F.concat(F.lit("x" * 420), F.hex("id"), F.sha2(F.col("id").cast("string"), 512)).alias("text"))
    pair = rows.groupBy(F.hash("text")).agg(F.min("text").alias("a"), F.max("text").alias("b"), F.count("*").alias("n")).where("n > 1").first()
    alone = "".join(random.Random(2).choices("pqrst", k=700))
    a, b = pair["a"][420:], pair["b"][420:]
    shared = "".join(random.Random(1).choices("abcdef", k=600))
    got, want = by_brute_force(spark, [(None, a + alone), (None, pair["a"]), (None, pair["b"]), (None, shared + a), (7, shared + b)])
    assert got == want


def test_very_many_equal_rows(spark, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefghij ", k=6000))
    near = text[:3000] + "!" + text[3000:]
    other = "".join(rng.choices("abcdefghij ", k=800))
    rows = [(7, text)] * 5000 + [(8, near), (None, near[1000:4000]), (9, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = sorted((tuple(r) for r in substrings.digests(docs).collect()), key=str)
    few = [(7, text)] * 2 + rows[5000:]
    want = [(i, *b) for (i, _), b in zip(few, brute([t for _, t in few]), strict=True)]
    assert got == sorted([want[0]] * 5000 + want[2:], key=str)
    for broadcast in (0, 1):  # joined by shuffle
        monkeypatch.setattr(substrings, "BROADCAST_ROWS", broadcast)
        assert sorted((tuple(r) for r in substrings.digests(docs).collect()), key=str) == got


def test_long_text(spark):
    rng = random.Random(6)
    long_ = "".join(rng.choices("abcdefghij ", k=700_000))
    own = long_[100_000:101_000]
    got, want = by_brute_force(spark, [(1, long_), (2, own), (3, "q" + long_[650_000:] + long_[:50_000])])
    assert got == want


def test_repeated_rows_and_empty(spark):
    x = "".join(random.Random(4).choice("abcdef") for _ in range(500))
    docs = spark.createDataFrame([(1, x), (1, x), (None, "z" + x[:450]), (2, "own")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.digests(docs).collect())
    assert got == [(0, 450), (1, 500), (1, 500), (2, 0)]
    assert substrings.digests(docs.limit(0)).count() == 0
