import random
from collections import Counter

from skarn.llm import decontaminate as d

RNG = random.Random(8)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 6))) for _ in range(300)]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def brute(docs, items):
    found = set()
    for i, t in docs:
        w = d.words(t)
        own = d.shingles(w)
        for k, item, answer in items:
            q, a = d.parts(item, answer)
            if not q and not a:
                continue
            if all(len(d.shingles(p) & own) >= 0.8 * len(d.shingles(p)) for p in (q, a)):
                found.add((i, k))
    return found


def fixture():
    items = [(k, sentence(RNG.randint(8, 60)) + ".", None) for k in range(80)] + [(80, None, None), (81, "", None)]
    docs = [(0, None), (1, ""), (2, items[3][1])]
    for i in range(3, 90):
        t = sentence(RNG.randint(1, 400)).split()
        if i % 3 == 0:
            item = items[RNG.randrange(80)][1].upper().split()
            if i % 9 == 0:  # not all of it
                item = item[: len(item) * 2 // 3]
            at = RNG.randint(0, len(t))
            t[at:at] = item
        docs.append((i, " ".join(t)))
    return docs, items


def test_against_brute_force(spark):
    docs, items = fixture()
    rows = spark.createDataFrame([(i, t, 1.0) for i, t in [*docs, docs[5]]], "doc_id long, text string, score double")
    bench = spark.createDataFrame([r[:2] for r in items], "item_id long, text string")
    got = d.leaks(rows, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items) and len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    kept = {r["doc_id"] for r in d.clean(rows, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in brute(docs, items)}


def test_wand_finds_what_scoring_all_finds():
    _, items = fixture()
    rows = [(k, *d.parts(t)) for k, t, _ in items[:80]]
    counts = Counter(t for _, q, a in rows for t in {*q, *a})
    x = d.build(rows, counts, len(rows), sum(len(q) + len(a) for _, q, a in rows) / len(rows))
    import numpy as np

    for share in (0.05, 0.2, 0.5):
        for _ in range(30):
            terms = np.array(sorted({x.term[w] for w in d.words(sentence(40)) if w in x.term}))
            scores = Counter()
            for t in terms.tolist():
                for n, v in zip(x.items[t], x.shares[t], strict=True):
                    scores[n] += v
            assert dict(d.wand(x, terms, share)).keys() == {n for n, s in scores.items() if s >= share - 1e-9}


def test_shards_and_answers(spark, monkeypatch):
    docs, items = fixture()
    monkeypatch.setattr(d, "SHARD_ITEMS", 7)
    monkeypatch.setattr(d, "PASS_POSTINGS", 900)  # several passes over the texts
    rows, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([r[:2] for r in items], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in d.leaks(rows, bench).collect()} == brute(docs, items)
    own = spark.createDataFrame([(1, "what is the name of the old red bridge", "it is called the golden bird bridge")], "item_id long, text string, answer string")
    texts = spark.createDataFrame([(1, "what is the name of the old red bridge"), (2, "what is the name of the old red bridge? it is called the golden bird bridge!")], "doc_id long, text string")
    assert [r["doc_id"] for r in d.leaks(texts, own).collect()] == [2]


def test_short_items_and_answers(spark):
    def held(phrase, text):  # by words, without the module's shingles
        p, t = phrase.lower().split(), text.lower().split()
        k = min(5, len(p))
        grams = {tuple(p[i : i + k]) for i in range(len(p) - k + 1)}
        return len(grams & {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}) / len(grams)

    rng = random.Random(3)
    items = [(n, " ".join(f"{rng.choice('abc')}{n}x{i}" for i in range(n))) for n in range(1, 31)]
    docs = []
    for n, text in items:
        w, lead, tail = text.split(), sentence(30), sentence(90)
        for k in {0, n // 2, max(0, n - 2), n - 1}:  # one word changed, or none
            for new in (w[k], "changed"):
                docs.append((len(docs), f"{lead} {' '.join([*w[:k], new, *w[k + 1 :]])} {tail}"))
        docs.append((len(docs), f"{lead} {' '.join(w[::-1])} {tail}"))
    want = {(i, k) for i, t in docs for k, item in items if held(item, t) >= 0.8}
    got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {k for _, k in want} == set(range(1, 31)) and {(r["doc_id"], r["item_id"]) for r in got} == want

    question = sentence(12)
    own = [(0, question, "zurich"), (1, question, "seven golden birds sang"), (2, "who was it", "a tall stranger from the far north coast of old thule")]
    texts = [question, f"{question} zurich", f"{question} it was said zurich", f"{question} seven golden birds sing", f"{question} seven birds", "who was it a tall stranger from the far north coast of old thule", "a tall stranger from the far north coast of old thule"]
    rows = spark.createDataFrame([(i, f"{sentence(20)} {t} {sentence(20)}") for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(own, "item_id long, text string, answer string")
    assert {(r["doc_id"], r["item_id"]) for r in d.leaks(rows, bench).collect()} == {(1, 0), (2, 0), (3, 1), (5, 2)}


def test_clean_where_ids_are_null_or_repeat(spark):
    item, other = sentence(30), sentence(30)
    rows = [(None, f"{other} {item}"), (None, other), (4, f"{item} {other}"), (4, other), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = d.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted([(None, other), (4, other), (5, None)], key=str)


def test_empty(spark):
    none, item = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.leaks(none, item).count() == 0
    assert d.leaks(spark.createDataFrame([(1, "text")], "doc_id long, text string"), item).count() == 0
    assert d.leaks(none, spark.createDataFrame([(1, "some text of an item")], "item_id long, text string")).count() == 0
