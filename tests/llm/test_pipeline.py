"""The pipeline as a whole against its stages' slow versions, one after the other."""

import hashlib
import random

import public_tokenizers

import corpus_pipeline
from skarn.llm import bpe, common, toxicity

from .test_bpe import reference
from .test_decontaminate import brute as leaked
from .test_pii import brute as personal
from .test_simhash import brute as grouped
from .test_simhash import slow as fingerprint
from .test_toxicity import slow_score

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.4 else "".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(3, 7))) for _ in range(n))


def fixture():
    rng = random.Random(5)
    clean = [prose(rng, rng.randint(20, 90)) for _ in range(120)]
    toxic = [prose(rng, 40) + " you stupid idiot, worthless idiot " + prose(rng, 40) for _ in range(60)]
    bench = [prose(rng, 40) for _ in range(5)]
    docs = [*enumerate(clean), *((1000 + i, t) for i, t in enumerate(toxic))]
    docs += [(2000, clean[3]), (2001, clean[4] + " mail me@there.org"), (2002, prose(rng, 50) + " " + bench[0] + " " + prose(rng, 50)), (2003, None), (2004, ""), (2005, "+1 (200) 555-1234"), (2006, "4111 1111 1111 1111, 10.0.0.1")]
    long = prose(rng, 30_000)
    docs += [(2007, long), (2008, long.replace(" the ", " THE ", 9)), (3, clean[3]), (5, prose(rng, 30)), (None, prose(rng, 30)), (None, prose(rng, 31)), (None, clean[7])]
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(1000 + i, 0, 1) for i in range(0, 60, 2)] + [(1, None, None)]
    return docs, labels, bench


def saved(spark, folder, docs, labels, bench):
    rows = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in docs], COLUMNS)
    # columns that clash with names inside, in another order
    rows.selectExpr("n_chars", "1 AS fp", "'x' AS ids", "source", "text", "true AS row", "lang", "doc_id", "2 AS label").repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def slow(spark, folder, docs, bench):
    model = toxicity.fit(toxicity.training_rows(common.table(spark, folder, "documents"), common.table(spark, folder, "labels")))
    docs = [(i, t) for i, t in docs if slow_score(t, model) < 0.5]
    # one of each group: least id, nulls last; of equal ids one text stays, which one the hash tells
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
    group = grouped([fingerprint(t) for _, t in docs])
    docs = [d for k, d in enumerate(docs) if group[k] == k]
    items = [(k, t, None) for k, t in enumerate(bench)]
    bad = {k for k, _ in leaked([(k, t) for k, (_, t) in enumerate(docs)], items)}
    docs = [d for k, d in enumerate(docs) if k not in bad]
    enc, out = reference(), []
    for i, t in docs:
        new, at = [], 0
        for kind, a, b in sorted(personal(t), key=lambda x: (x[1], x[2])):
            if a >= at:
                new += [t[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        new = "".join([*new, (t or "")[at:]])
        ids = enc.encode_ordinary(new)
        out.append((i, None if t is None else len(new), len(ids), ids, hashlib.sha256(new.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_the_stages_slow_versions(spark, tmp_path):
    docs, labels, bench = fixture()
    folder = saved(spark, tmp_path, docs, labels, bench)
    rows = corpus_pipeline.run(spark, folder).collect()
    got = sorted(((r["doc_id"], r["n_chars"], r["n_tokens"], r["ids"], r["decoded_sha256"]) for r in rows), key=str)
    want = slow(spark, folder, docs, bench)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert got == want
    ids = [g[0] for g in got]
    assert not {i for i in ids if i and 1000 <= i < 2000} and 2000 not in ids and 2002 not in ids and {2005, 2006, 2007} <= set(ids)
    # of the null and the empty text, which are copies, the one of least id stays
    assert 2003 in ids and 2004 not in ids and ids.count(3) == 1 and ids.count(5) == 2 and ids.count(None) == 2
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "byte_bpe"]


def test_empty_table(spark, tmp_path):
    _, labels, bench = fixture()
    folder = saved(spark, tmp_path, [], labels, bench)
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_round_trip_is_encoding_then_decoding(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(1, "a b c", 7), (1, "a b c", 7), (2, None, None), (None, "é" * 3000, 1)], "doc_id long, text string, n long")
    there = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=("n",))
    key = lambda r: str(r)
    assert sorted(bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep=("n",)).collect(), key=key) == sorted(bpe.decode(there, path, keep=("n",)).collect(), key=key)
