"""Byte-level BPE by two-tier lookup, and its decoding.

A text falls into pre-tokens by a pattern. Tier one: a minimal perfect hash finds a pre-token that
is itself in the vocabulary. Tier two: a heap of adjacent pairs over linked bytes merges the others
in rank order. Words repeat, so each worker keeps what it has resolved, up to a bound.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Words, and pre-tokens, that each of the two generations of what a worker remembers holds: some 150 MB in all.
WORDS, PIECES = 280_000, 180_000
#: Characters of the longest of them that is remembered: what a worker keeps is bounded in bytes.
WORD_LENGTH = 64
#: Lists of ids decoded at a time.
SLICE = 512
#: Ids that are decoded at a time.
DECODE_BLOCK = 1 << 19
_TWO_SPACES = re.compile(r"\s\s")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by id; ids must be 0 to n - 1."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError(f"{path}: ids have gaps")
    return [tokens[i] for i in range(len(tokens))]


class MinimalPerfectHash:
    """Each of n keys to its own slot of n: hash to a bucket, whose displacement moves its keys to free slots."""

    def __init__(self, keys: list[bytes], per_bucket: int = 3) -> None:
        self.n = n = len(keys)
        self.buckets = max(1, n // per_bucket)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for h in hashes:
            members[(h >> 40) % self.buckets].append(h)
        self.shift = [0] * self.buckets
        taken, free = bytearray(n), n - 1
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) == 1:  # any free slot will do, kept as such
                while taken[free]:
                    free -= 1
                taken[free] = 1
                self.shift[b] = ~free
            elif members[b]:
                d = 0
                while True:
                    slots = {(h * (2 * d + 1) >> 20 & 0xFFFFFFFF) % n for h in members[b]}
                    if len(slots) == len(members[b]) and not any(taken[s] for s in slots):
                        break
                    d += 1
                    if d > 1000 + 50 * n:
                        raise ValueError("keys repeat or share a hash")
                for s in slots:
                    taken[s] = 1
                self.shift[b] = d
        self.key: list[bytes] = [b""] * n
        self.value = [0] * n
        for i, k in enumerate(keys):
            s = self._slot(hashes[i])
            self.key[s], self.value[s] = k, i

    def _slot(self, h: int) -> int:
        d = self.shift[(h >> 40) % self.buckets]
        return ~d if d < 0 else (h * (2 * d + 1) >> 20 & 0xFFFFFFFF) % self.n

    def get(self, key: bytes) -> int:
        """The key's number, -1 for a stranger."""
        s = self._slot(xxhash.xxh64_intdigest(key))
        return self.value[s] if self.key[s] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: the pair of least rank first, the leftmost of equals."""
    n, find = len(piece), ranks.get
    end = list(range(1, n + 1))  # where the part that starts here ends; 0: no part starts here
    before = list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := find(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, e = heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != e:
            continue  # one of the two parts is gone
        end[i], end[j] = e, 0
        if e < n:
            before[e] = i
            if (r := find(piece[i : end[e]])) is not None:
                heappush(heap, (r, i, end[e]))
        if (p := before[i]) >= 0 and (r := find(piece[p:e])) is not None:
            heappush(heap, (r, p, e))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class _Known(dict):
    """Words to their ids as bytes, resolved on first sight; when full, what wasn't used since the last time goes."""

    def __init__(self, resolve: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.resolve, self.most, self.old = resolve, most, {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > WORD_LENGTH:
            return self.resolve(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        found = self.old.get(word)
        if found is None:
            found = self.resolve(word)
        self[word] = found
        return found


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.whole = MinimalPerfectHash(tokens).get
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.pattern = regex.compile(pattern)
        self.piece = _Known(self._piece, PIECES)
        self.spaced = _Known(lambda word: self._pieces(" " + word), WORDS)

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        whole = self.whole(raw)
        return pack(f"<{len(ids)}i", *ids) if whole < 0 and (ids := merge(raw, self.ranks)) else pack("<i", whole)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, (m.group() for m in self.pattern.finditer(text))))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers. A space between two other characters always starts
        a pre-token, so the words between such spaces are resolved alone."""
        words = _BETWEEN.split(text) if _TWO_SPACES.search(text) else text.split(" ")
        return self._pieces(words[0]) + b"".join(map(self.spaced.__getitem__, words[1:]))


@functools.lru_cache(maxsize=2)
def _encoder(tokens: tuple[bytes, ...], pattern: str) -> Encoder:
    return Encoder(list(tokens), pattern)


_Batches = Iterator[pa.RecordBatch]


def _encoding(ranks_path: str, pattern: str) -> Callable[[_Batches], _Batches]:
    """Batches (id, text, others) to (id, ids, others)."""
    tokens = tuple(read_ranks(ranks_path))

    def run(batches: _Batches) -> _Batches:
        one = _encoder(tokens, pattern).encode
        for part in slices(batches, 1):
            found = [one(t) for t in part.column(1).to_pylist()]
            offsets = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), ids, *part.columns[2:]], names=[part.schema.names[0], "ids", *part.schema.names[2:]])

    return run


def _decoding(ranks_path: str) -> Callable[[_Batches], _Batches]:
    """Batches (id, ids, others) to (id, ids, decoded, others)."""
    tokens = read_ranks(ranks_path)
    book = np.frombuffer(b"".join(tokens), np.uint8)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.cumsum(sizes) - sizes

    def run(batches: _Batches) -> _Batches:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            column = batch.column(1)
            ids = column.flatten().to_numpy(zero_copy_only=False)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes)):
                raise ValueError("an id is not in the vocabulary")
            blocks, total = [], np.concatenate(([0], np.cumsum(sizes[ids])))
            for at in range(0, len(ids), DECODE_BLOCK):
                some = ids[at : at + DECODE_BLOCK]
                n = sizes[some]
                blocks.append(book[np.arange(n.sum()) + np.repeat(starts[some] - (np.cumsum(n) - n), n)])
            offsets = column.offsets.to_numpy().astype(np.int64)
            ends = total[offsets - offsets[0]].astype(np.int64)
            raw = np.concatenate(blocks) if blocks else np.empty(0, np.uint8)
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), column, text, *batch.columns[2:]], names=[batch.schema.names[0], "ids", "decoded", *batch.schema.names[2:]])

    return run


def _fields(rows: DataFrame, id_col: str, keep: tuple[str, ...], decoded: bool) -> T.StructType:
    more = [T.StructField("decoded", T.BinaryType())] if decoded else []
    return T.StructType([rows.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())), *more, *(rows.schema[k] for k in keep)])


def _texts(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("__text"), *keep)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ids array<int>, the columns ``keep``) for each row of ``docs``, without special tokens.

    Null and empty texts have no ids (an empty array). Rows come back as often as they came;
    null ids stay null; other columns are not read. The rank file is read on the driver only.
    The pattern must make a space that stands between two other characters start a pre-token.
    """
    rows = _texts(docs, id_col, text_col, keep)
    return rows.mapInArrow(_encoding(ranks_path, pattern), _fields(rows, id_col, keep, False))


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ids, decoded, the columns ``keep``) of ``encoded``: decoded are the bytes that the ids stand for; no ids or null: empty.
    Unknown ids raise. Rows come back as often as they came."""
    rows = encoded.select(id_col, F.coalesce(ids_col, F.array().cast("array<int>")).alias("ids"), *keep)
    return rows.mapInArrow(_decoding(ranks_path), _fields(rows, id_col, keep, True))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``decode`` of ``encode``, both in one Python worker of a task: the ids needn't go back to the JVM in between."""
    rows, there, back = _texts(docs, id_col, text_col, keep), _encoding(ranks_path, pattern), _decoding(ranks_path)
    return rows.mapInArrow(lambda batches: back(there(batches)), _fields(rows, id_col, keep, True))


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoded, decoded again, and digested."""
    rows = round_trip(docs, ranks_path, pattern, id_col, text_col)
    return rows.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
