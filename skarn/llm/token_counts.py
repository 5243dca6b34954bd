"""Token counts under a unigram model: each text's least-cost segmentation, without making it.

Distinct pre-tokens are inserted in a trie. Each node keeps the least cost of the characters up to it
(the forward score), computed when the node is made and so once for all pre-tokens that share the
prefix; at a pre-token's end the score holds the number of tokens, which is stored by pre-token. A
worker's trie serves all its tasks and starts anew when it is full.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: What stands before a pre-token, for the blank.
BLANK = "▁"
#: Costs are whole numbers of this part of a nat, so that sums and ties are exact.
UNIT = 1e-6
#: A cost takes the bits above these, the number of tokens those below: least cost first, then fewest tokens.
COUNT_BITS = 32
#: Pre-tokens in each of the two generations whose counts a worker stores, nodes of its trie (some 150 bytes each), and texts taken at a time at most.
WORDS, NODES, SLICE = 400_000, 500_000, 4096
#: Characters of a pre-token that get nodes, and of the longest whose count is stored. Those behind them are scored without nodes.
WORD_LENGTH = 64


def read_pieces(path: str) -> dict[str, int]:
    """Costs of a sentencepiece model's pieces. Ids go from frequent to rare, so piece number n (from 1)
    has the probability 1 / n, up to a constant that all share: the cost ln n + ln(sum of 1 / n)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and (p := model.id_to_piece(i))]
    total = log(sum(1 / n for n in range(1, len(plain) + 1)))
    return {p: round((log(n) + total) / UNIT) for n, p in enumerate(plain, 1)}


class Trie:
    """Prefixes of pre-tokens with their forward scores; node 0 is the empty prefix."""

    def __init__(self, costs: dict[str, int], most: int = NODES) -> None:
        self.pieces = {p: (c << COUNT_BITS) + 1 for p, c in costs.items()}
        self.lengths = sorted({len(p) for p in costs})
        # a character in no piece: its bytes, each rarer than every piece
        self.byte = ((max(costs.values(), default=0) + round(1 / UNIT)) << COUNT_BITS) + 1
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # by node and character
        self.score = [0]

    def insert(self, word: str) -> int:
        """The forward score of ``word``; nodes that are there already aren't computed again."""
        head = word[:WORD_LENGTH]
        if len(self.score) + len(head) > self.most:
            self.clear()
        child, score = self.child, self.score
        node, path = 0, [0]  # the scores of the prefixes so far
        for end, c in enumerate(head, 1):
            key = node << 21 | ord(c)
            node = child.get(key)
            if node is None:
                node = child[key] = len(score)
                score.append(self._least(word, end, path, 0))
            path.append(score[node])
        return path[-1] if len(head) == len(word) else self._rest(word, path)

    def _least(self, word: str, end: int, path: list[int], start: int) -> int:
        """The least cost up to ``end``; ``path``: the scores of the prefixes from ``start`` characters on."""
        get = self.pieces.get
        least = path[-1] + self.byte * len(word[end - 1].encode("utf-8"))
        for n in self.lengths:
            if n > end:
                break
            w = get(word[end - n : end])
            if w is not None and (x := path[end - n - start] + w) < least:
                least = x
        return least

    def _rest(self, word: str, path: list[int]) -> int:
        """The score of a long word, of which ``path`` has the first characters'; no more scores are kept than a piece may reach back."""
        start, reach = 0, max(self.lengths, default=1)
        for end in range(len(path), len(word) + 1):
            path.append(self._least(word, end, path, start))
            if len(path) > 4096 + reach:
                start += len(path) - reach
                del path[:-reach]
        return path[-1]


class Counter:
    """Token counts of pre-tokens."""

    def __init__(self, costs: dict[str, int]) -> None:
        self.trie = Trie(costs)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def count(self, words: list[str]) -> list[int]:
        """Tokens of each of the distinct ``words``."""
        found, insert = [], self.trie.insert
        for w in words:
            n = self.young.get(w)
            if n is None and len(w) > WORD_LENGTH:
                n = insert(BLANK + w) & ((1 << COUNT_BITS) - 1)
            elif n is None:
                if len(self.young) >= WORDS:
                    self.young, self.old = {}, self.young
                n = self.old.get(w)
                if n is None:
                    n = insert(BLANK + w) & ((1 << COUNT_BITS) - 1)
                self.young[w] = n
            found.append(n)
        return found


@functools.lru_cache(maxsize=2)
def _counter(costs: tuple[tuple[str, int], ...]) -> Counter:
    return Counter(dict(costs))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pretokens, n_tokens) for each row of ``docs``.

    Pre-tokens are what lies between ASCII white space, with a blank's sign before. Null and empty
    texts have neither. Rows come back as often as they came; other columns are not read. Characters
    in no piece count their bytes. The model's file is read on the driver.
    """
    costs = tuple(read_pieces(model_path).items())
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(costs).count
        for batch in slices(batches, 1, SLICE):
            words = pc.ascii_split_whitespace(batch.column(1))
            coded = words.flatten().dictionary_encode()
            distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            # white space at a text's end leaves an empty word there
            sizes = np.array([0 if not w else 1 for w in distinct], np.int64)
            tokens = np.array(count(distinct), np.int64) * sizes
            at, offsets = coded.indices.to_numpy(), words.offsets.to_numpy()
            offsets = offsets - offsets[0]
            out = [np.diff(np.concatenate(([0], np.cumsum(x[at])))[offsets]) for x in (sizes, tokens)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=[id_col, "n_pretokens", "n_tokens"])

    return rows.mapInArrow(run, T.StructType([rows.schema[id_col], T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())]))
