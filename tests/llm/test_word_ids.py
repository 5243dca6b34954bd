import random

import public_tokenizers
import pyarrow as pa

from skarn.llm import huffman


def test_words_together_are_as_the_library_encodes_them():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        w = huffman._WordIds(f.read())
    assert w.lowered and w.mark is not None
    rng = random.Random(5)
    abc = [*"abcdefIJAHTKé#.,'0129<|>ß漢Σİ\x01\x02 \n", "́", "̌", "̈", "<|endoftext|>", "<|ENDOFTEXT|>", "'s"]
    texts = ["".join(rng.choice(abc) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", "\x01", "#\x01 a\x01b"]
    want = [x.ids for x in w.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    sizes, ids = w.encode(pa.array(texts))
    assert sizes.tolist() == [len(x) for x in want]
    assert ids.tolist() == [y for x in want for y in x]
