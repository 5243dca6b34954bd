import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from skarn.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "  a  b\n c ", "x\n\n y", "ab's  don't I'LL", "日本語 テスト ²½ x²", "\x1c a\x1cb \x85 c\xa0d e", " a", "a ", "\n a\n", "foo \n bar", "😀 😀😀 é\u0302 ñ", "word " * 3000, "a" * 5000, "\t\t\tif x:\n\t\treturn  1"]


def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_tiktoken(spark):
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)] + [(None, "again", [1])], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: r for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    enc = reference()
    for i, t in [*enumerate(TEXTS), (None, "again")]:
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_minimal_perfect_hash():
    keys = [b"key%d" % i for i in range(3000)]
    h = bpe.MinimalPerfectHash(keys)
    assert [h.get(k) for k in keys] == list(range(3000))
    assert sorted(h._slot(bpe.xxhash.xxh64_intdigest(k)) for k in keys) == list(range(3000))
    assert h.get(b"stranger") == -1


def test_memory_is_bounded():
    enc = bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    enc.spaced.most = enc.piece.most = 4
    text = " ".join(f"w{i % 11}" for i in range(200))
    assert np.frombuffer(enc.encode(text), np.int32).tolist() == reference().encode_ordinary(text)
    assert len(enc.spaced) <= 4 and len(enc.spaced.old) <= 4


def test_empty(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).count() == 0
