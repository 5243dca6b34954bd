import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from skarn.llm import common, variants
from skarn.llm.common import table

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(docs):
    found = Counter()
    for number, text in docs:
        for run in RUN.findall(text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if number is None else number}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                found[w] += 1
    return {w: n for w, n in found.items() if n >= 3}


def brute(docs):
    """Each word against all strings that one edit makes of it."""
    words = counted(docs)
    letters = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        cuts = {w[:i] + w[i + 1 :] for i in range(len(w))}
        swaps = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        more = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = {x for x in cuts | swaps | more if x in words and x != w}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def some_docs():
    rng = random.Random(7)
    base = ["".join(rng.choices("aeinrstéüß", k=rng.randint(4, 9))) for _ in range(150)]

    def edited(w):
        i, c = rng.randrange(len(w)), rng.choice("aeinrstxéÿ÷É")
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i] + w[i:]])

    words = [w for w in base for _ in range(rng.choice([1, 3, 9, 40]))]
    for _ in range(3):
        words += [x for w in rng.choices(words, k=400) for x in [edited(w)] * rng.randint(1, 4)]
    rng.shuffle(words)
    docs = [(rng.choice([None, k, k]), rng.choice([" ", ", ", "-", "9"]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in words[k * 10 : k * 10 + 10])) for k in range(len(words) // 10)]
    return docs + [docs[0]] * 3 + [(1, None), (2, ""), (3, "..."), (4, " ".join(words[:20] * 400))]


def check(spark):
    docs = some_docs()
    rows = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, word int").repartition(3)
    got = variants.variants(rows)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(docs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert any(r[1] not in (None, r[2]) for r in want) and any(r[4] > 5 for r in want)


def test_against_brute_force(spark):
    check(spark)


def test_hot_bands_are_split(spark, monkeypatch):
    monkeypatch.setattr(variants, "HOT_KEYS", 10**9)
    monkeypatch.setattr(variants, "max", lambda *x: 2, raising=False)
    check(spark)


def test_chains_and_ties(spark):
    counts = {"abcde": 3, "abcdef": 6, "abcdefg": 12, "abcdefgh": 24, "abcdefghi": 48, "abcdefghij": 96, "abcdefghijk": 192, "xbcde": 6, "zzzzz": 5, "zzzzy": 9}
    docs = [(1, " ".join([w] * n)) for w, n in counts.items()]
    rows = variants.vocabulary(spark.createDataFrame(docs, "doc_id long, text string"), damaged=None)
    assert {r["word"]: r["n"] for r in rows.collect()} == counts
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in variants.variants(spark.createDataFrame(docs, "doc_id long, text string"), damaged=None).collect()}
    assert got["abcde"] == ("abcdef", "abcdefghijk", 2) and got["zzzzz"] == (None, "zzzzz", 1)


def test_empty(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants.variants(spark.createDataFrame([(None, None), (1, "ab cd")], "doc_id long, text string")).count() == 0


def test_bits_are_one_to_a_letter(spark):
    words = spark.createDataFrame([(c * 1 + "aaaaa", 1) for c in variants.LETTERS], "word string, n long")
    own = variants.bands(words)
    assert sorted("".join(own)) == sorted(variants.LETTERS) and {len(x) for x in own} == {30}
    got = [(r["b0"], r["b1"], r["b2"]) for r in variants.masks(words, own).collect()]
    assert len(set(got)) == len(variants.LETTERS) and max(map(max, got)) < 2**31


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert sorted((tuple(r) for r in variants.variants(docs).collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
