import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from skarn.llm import huffman

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_code_is_optimal_and_limited():
    counts = {i: 2**i for i in range(24)}
    lengths = huffman.code_lengths(counts, 8)
    assert max(lengths.values()) <= 8 and sum(2.0**-n for n in lengths.values()) == 1
    # without a limit: Huffman's own total
    rng = random.Random(1)
    counts = {i: rng.randint(1, 1000) for i in range(300)}
    import heapq

    heap, total = sorted(counts.values()), 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    assert sum(counts[i] * n for i, n in huffman.code_lengths(counts, 18).items()) == total
    assert huffman.code_lengths({7: 5}) == {7: 1} and huffman.code_lengths({}) == {}


def test_pack_and_unpack():
    rng = np.random.default_rng(3)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = np.minimum(rng.geometric(0.05, n) - 1, 400).astype(np.int32)
        lengths = huffman.code_lengths({i: int((ids == i).sum()) + 1 for i in range(401)}, 12)
        order, sizes, codes = huffman.canonical(lengths)
        size, code = np.zeros(401, np.int64), np.zeros(401, np.int64)
        size[order], code[order] = sizes, codes
        bits, checkpoints = huffman.pack(ids, size, code)
        assert len(bits) == (size[ids].sum() + 7) // 8
        table = huffman.decoding_table(order, sizes, codes, 12)
        assert huffman.unpack(bits, checkpoints, n, *table, 12).tolist() == ids.tolist()


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 300)
    rng = random.Random(9)
    texts = ["", None, "  ", "<|endoftext|> x", "ΟΔΟΣ İstanbul\u00a0é e\u0301 \u2028 x", "it's 12 tests!! DON'T '''s a1b22-c x<|y \x1c<|startoftext|>z", " ".join(rng.choice(["one", "Two", "three3", "¿qué?"]) for _ in range(2000)), "日本語 テスト"]
    rows = [(i * 7 - 3, t, 0) for i, t in enumerate(texts * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(6)
    got = {r["doc_id"]: r for r in huffman.round_trip(docs, PATH, 1, str(tmp_path / "f")).collect()}
    t, at = Tokenizer.from_file(PATH), 0
    assert len(got) == len(rows)
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_empty_and_repeated(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert huffman.round_trip(none, PATH, 1, str(tmp_path / "n")).count() == 0
    same = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    got = sorted((r["start"], r["n_tokens"]) for r in huffman.round_trip(same, PATH, 1, str(tmp_path / "s")).collect())
    assert got == [(0, 2), (2, 2), (4, 2)]


def test_one_id_on_very_many_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 200)
    long_ = "word " * 30_000
    rows = [(5, "the same text")] * 900 + [(k, f"text number {k}") for k in range(300)] + [(5, f"of five {k}") for k in range(300)] + [(None, "none")] * 200 + [(6, long_)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = str(tmp_path / "f")
    got = huffman.round_trip(docs, PATH, 1, path).collect()
    t = Tokenizer.from_file(PATH)
    sizes = {x: len(t.encode(x, add_special_tokens=False).ids) + 1 for _, x in rows}
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((i is not None, i or 0, sizes[x]) for i, x in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == [None] * 200 + sorted(i for i, _ in rows if i is not None)
    blocks = spark.read.parquet(f"{path}/blocks")
    hot = {r["bucket"]: sum(d == 5 for d in r["doc_ids"]) for r in blocks.collect() if 5 in r["doc_ids"]}
    assert len(hot) >= 6
    assert blocks.where("bucket < 0").select("bucket").distinct().count() > 30
