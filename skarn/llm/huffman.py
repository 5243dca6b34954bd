"""Token ids as a file of canonical, length-limited Huffman codes.

The code comes from the global counts of the ids. The file is a Parquet table of blocks in the order
of the documents, each decodable by itself: its documents' ids and lengths, its packed bits, and
the bit offset of every ``STRIDE``-th id. Decoding looks up a table by the next ``LONGEST`` bits,
at all of a task's checkpoints in step.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import removed, slices, split_buckets, written

#: Longest code, and bits that index the decoding table.
LONGEST = 18
#: Ids between two checkpoints.
STRIDE = 256
#: Ids from which a block is full; a document stays whole.
BLOCK_IDS = 1 << 16
#: Buckets of rows without an id.
NULL_BUCKETS = 256
#: Words in each of the two generations that a worker remembers, and texts encoded at a time at most.
WORDS, SLICE = 250_000, 8192
#: Characters of the longest word that is remembered, which bounds what a worker keeps in bytes.
WORD_LENGTH = 64
#: Numbers that rows get in turn, to spread those of one id.
SALTS = 1 << 12
#: Bytes of texts encoded at a time: the more, the more words come again.
SLICE_TEXT = 4 << 20
#: Words encoded as one text, and what stands between them there.
JOINED, MARK = 256, "\x01"
#: Texts whose capitals count before they are lowered: names of special tokens, and marks that compose with one case only.
_CASED = r"<\||[\x{0300}-\x{036f}]"
_BLOCK = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("first_id", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("checkpoints", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())])


# --- ids -----------------------------------------------------------------------------------------


def _rules(tokenizer: dict) -> tuple[bool, bool]:
    """(by_word, lowered): whether words between white space can be encoded one by one, and whether they are lowered first."""
    normalizers, parts = ((r or {}).get(many, [r] if r else []) for r, many in ((tokenizer["normalizer"], "normalizers"), (tokenizer["pre_tokenizer"], "pretokenizers")))
    known = [{"type": "NFC"}, {"type": "Lowercase"}, blank := {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}]
    splits = [p for p in parts if p["type"] == "Split"]
    rest = [p for p in parts if p["type"] != "Split"]
    # white space becomes one blank; what the one pattern doesn't match is removed, a blank always, and nothing else parts or adds
    plain = blank in normalizers and all(n in known for n in normalizers)
    plain = plain and len(splits) == 1 and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and "Regex" in splits[0]["pattern"]
    plain = plain and all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in rest)
    kinds = splits[0]["pattern"]["Regex"].split("|") if plain else []
    classes = [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]
    # letters, numbers, other signs, and contractions: no alternative looks around or holds a blank
    by_word = plain and all(k in classes or re.fullmatch("'[a-z]+", k) for k in kinds)
    return by_word, by_word and {"type": "Lowercase"} in normalizers


class _WordIds:
    """Ids of texts, by their words: white space always parts this tokenizer's input, so a word is encoded once."""

    def __init__(self, tokenizer_json: str) -> None:
        # one task is one thread
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.by_word, self.lowered = _rules(json.loads(tokenizer_json))
        mark = self.tokenizer.encode(f" {MARK} ", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of each word, of many in one text. Each mark between them has one id; if that id comes
        oftener, a word holds it too, and the words are encoded one by one."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)] if self.mark is not None else [[w] for w in words]
        found = []
        for own, x in zip(groups, self.tokenizer.encode_batch_fast([f" {MARK} ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, np.int32)
            at = np.flatnonzero(ids == self.mark) if len(own) > 1 else []
            if len(at) == len(own) - 1:
                raw, ends = ids.tobytes(), [-4, *(4 * np.array(at, np.int64)).tolist(), 4 * len(ids)]
                found += [raw[a + 4 : b] for a, b in zip(ends, ends[1:], strict=False)]
            else:
                found += [array("i", y.ids).tobytes() for y in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
        return found

    def _resolve(self, words: list[str]) -> list[bytes]:
        found = self._together(words)
        if len(self.young) + len(found) > WORDS:
            self.young, self.old = {}, self.young
        self.young.update((w, x) for w, x in zip(words, found, strict=True) if len(w) <= WORD_LENGTH)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of the texts."""
        if not self.by_word:
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([len(x) for x in ids], np.int64), np.array([y for x in ids for y in x], np.int32)
        if self.lowered:  # a word and its capitalised form are then one
            texts = pc.if_else(pc.match_substring_regex(texts, _CASED), texts, pc.ascii_lower(texts))
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        of = list(map(self.young.get, distinct))
        missing = [i for i, x in enumerate(of) if x is None]
        for i in missing:
            if (x := self.old.get(distinct[i])) is not None:
                of[i] = self.young[distinct[i]] = x
        missing = [i for i in missing if of[i] is None]
        for at in range(0, len(missing), 8192):
            some = missing[at : at + 8192]
            for i, x in zip(some, self._resolve([distinct[i] for i in some]), strict=True):
                of[i] = x
        size = np.fromiter(map(len, of), np.int64, len(of)) // 4
        book = np.frombuffer(b"".join(of), np.int32)
        start = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = book[np.arange(ends[-1]) + np.repeat(start[at] - ends[:-1], n)]
        offsets = words.offsets.to_numpy()
        return np.diff(ends[offsets - offsets[0]]), ids


@functools.lru_cache(maxsize=2)
def _word_ids(tokenizer_json: str) -> _WordIds:
    return _WordIds(tokenizer_json)


def _packed(ids: np.ndarray, sizes: np.ndarray, width: int) -> pa.Array:
    """Each row's ids as bytes."""
    raw = ids.astype(f"<u{width}")
    ends = (np.concatenate(([0], np.cumsum(sizes))) * width).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary())


def unpacked(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a column of packed ids."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw.view(f"<u{width}"), ((offsets - offsets[0]) // width).astype(np.int64)


def id_width(tokenizer_path: str, end_id: int) -> int:
    """Bytes that an id takes between the stages: 2 where all ids fit, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(end_id + 1, Tokenizer.from_file(tokenizer_path).get_vocab_size()) <= 1 << 16 else 4


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, salt): each row's ids and ``end_id``, as bytes of ``id_width`` an id, least first, and its number in its task, which repeats. Null
    texts are empty and have the end id only. The tokenizer's file is read on the driver."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    width = id_width(tokenizer_path, end_id)
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = _word_ids(tokenizer_json).encode, 0
        for own in slices(batches, 1, SLICE, SLICE_TEXT):
            sizes, ids = encode(own.column(1))
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            salt = (np.arange(own.num_rows) + at) % SALTS
            at += own.num_rows
            yield pa.RecordBatch.from_arrays([own.column(0), _packed(ids, sizes + 1, width), pa.array(salt, pa.int32())], names=[id_col, "ids", "salt"])

    return rows.mapInArrow(run, T.StructType([rows.schema[id_col], T.StructField("ids", T.BinaryType()), T.StructField("salt", T.IntegerType())]))


# --- code ----------------------------------------------------------------------------------------


def code_lengths(counts: dict[int, int], longest: int = LONGEST) -> dict[int, int]:
    """Optimal lengths of at most ``longest`` bits (package-merge); one symbol alone has one bit."""
    if len(counts) > 1 << longest:
        raise ValueError(f"{len(counts)} ids need more than {longest} bits")
    leaves = sorted((n, (s,)) for s, n in counts.items())
    if len(leaves) < 2:
        return {s: 1 for _, (s,) in leaves}
    # a package is kept as its number; what it holds is counted from the last list back
    weights = [n for n, _ in leaves]
    lists = [[(w, i, -1) for i, w in enumerate(weights)]]
    for _ in range(longest - 1):
        last = lists[-1]
        packages = [(last[i][0] + last[i + 1][0], i, i + 1) for i in range(0, len(last) - 1, 2)]
        lists.append(list(heapq.merge([(w, i, -1) for i, w in enumerate(weights)], packages, key=lambda x: x[0])))
    lengths = [0] * len(leaves)
    take = 2 * len(leaves) - 2
    for level in reversed(lists):
        packages = 0
        for _, i, j in level[:take]:
            if j < 0:
                lengths[i] += 1
            else:
                packages += 1
        take = 2 * packages
    return {s: n for (_, (s,)), n in zip(leaves, lengths, strict=True)}


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, lengths, codes) in the order of (length, id): the code is what the lengths alone say."""
    order = sorted((n, s) for s, n in lengths.items())
    codes, code, last = [], 0, order[0][0] if order else 0
    for n, _ in order:
        code <<= n - last
        codes.append(code)
        code, last = code + 1, n
    return np.array([s for _, s in order], np.int64), np.array([n for n, _ in order], np.int64), np.array(codes, np.int64)


def pack(ids: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, checkpoints) of ``ids``; ``size`` and ``code`` by id. The first bit is a byte's highest."""
    n = size[ids]
    ends = np.cumsum(n)
    starts = ends - n
    total = int(ends[-1]) if len(ids) else 0
    # each code lies in one or two words of 32 bits
    word, shift = starts >> 5, 64 - (starts & 31) - n
    value = code[ids] << shift
    words = (total + 31) // 32 + 1
    sums = np.bincount(word, value >> 32, words) + np.bincount(word + 1, value & 0xFFFFFFFF, words + 1)[:words] if len(ids) else np.zeros(words)
    return sums.astype(np.uint32).astype(">u4").tobytes()[: (total + 7) // 8], starts[::STRIDE]


def decoding_table(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) by the next ``longest`` bits; length 0 where no code begins so."""
    symbol, size = np.zeros(1 << longest, np.int32), np.zeros(1 << longest, np.int64)
    spans = np.left_shift(1, longest - lengths)
    starts = codes << (longest - lengths)
    at = np.repeat(starts - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
    symbol[at], size[at] = np.repeat(ids, spans), np.repeat(lengths, spans)
    return symbol, size


def unpack(bits: bytes, checkpoints: np.ndarray, count: int, symbol: np.ndarray, size: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The ``count`` ids of a block: from all its checkpoints at once, step by step. Bits that are no code raise."""
    raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.int64)
    # the 32 bits from each byte on
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    lanes, out = np.array(checkpoints, np.int64), np.zeros((len(checkpoints), STRIDE), np.int32)
    last = count - (len(lanes) - 1) * STRIDE
    for k in range(min(count, STRIDE)):
        if k == last and len(lanes) and len(lanes) == len(checkpoints):
            lanes = lanes[:-1]
        peek = window[lanes >> 3] >> (32 - longest - (lanes & 7)) & ((1 << longest) - 1)
        n = size[peek]
        if not n.all():
            raise ValueError("these bits hold no code")
        out[: len(lanes), k] = symbol[peek]
        lanes = lanes + n
    return out.reshape(-1)[:count]


# --- file ----------------------------------------------------------------------------------------


def counts(encoded: DataFrame, width: int) -> dict[int, int]:
    """Global counts; each task sums its own first. At most one row for each id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            own = np.bincount(unpacked(batch.column(0), width)[0], minlength=len(total))
            own[: len(total)] += total
            total = own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows["id"].to_pylist(), rows["n"].to_pylist(), strict=True))


def write(encoded: DataFrame, path: str, width: int, id_col: str = "doc_id", longest: int = LONGEST) -> None:
    """The file of ``encoded`` (id, packed ids, salt) in ascending order of id; ties in the order of their buckets and bytes. ``salt``, a
    number that equal rows don't share (by default a hash of the ids), deals the rows of a frequent id to several buckets.

    ``path/code`` has the code's lengths, ``path/blocks`` the blocks. Null ids come first, in the order of
    their buckets and bytes. A bucket holds neighbouring documents, as many in one as in another; where its
    ids stand in the whole follows from the sums of those before, which are a row for a bucket.
    """
    spark = encoded.sparkSession
    lengths = code_lengths(counts(encoded, width), longest)
    ids, sizes, codes = canonical(lengths)
    spark.createDataFrame(pa.table({"id": ids, "length": sizes}), "id long, length long").coalesce(1).write.parquet(f"{path}/code")
    size, code = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64), np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    size[ids], code[ids] = sizes, codes
    # rows of null id, which come first, and those of one id that very many have are spread
    salt = F.col("salt") if "salt" in encoded.columns else F.xxhash64("ids")
    bucket = F.coalesce(split_buckets(encoded, id_col, salt), -1 - F.pmod(salt, F.lit(NULL_BUCKETS)).cast("int"))
    rows = encoded.select(bucket.cast("long").alias("bucket"), F.col(id_col).cast("long").alias("id"), "ids")
    starts = _starts(rows.groupBy("bucket").agg(F.sum(F.expr(f"octet_length(ids) div {width}")).alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, block, before, held, docs, mine, first = None, 0, 0, 0, [], [], 0

        def out() -> pa.RecordBatch:
            own = np.concatenate(mine)
            bits, checkpoints = pack(own, size, code)
            row = {"bucket": bucket, "block": block, "first_id": first, "doc_ids": docs, "sizes": [len(m) for m in mine], "checkpoints": checkpoints.tolist(), "bits": bits}
            return pa.RecordBatch.from_pylist([row], pa.schema([("bucket", pa.int64()), ("block", pa.int32()), ("first_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())), ("bits", pa.binary())]))

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 3)]
            flat, offsets = unpacked(batch.column(2), width)
            for k, (b, doc, start) in enumerate(zip(*columns, strict=True)):
                if b != bucket or held >= BLOCK_IDS:
                    if mine:
                        yield out()
                    if b != bucket:
                        bucket, block, before = b, -1, start
                    block, held, docs, mine, first = block + 1, 0, [], [], before
                own = flat[offsets[k] : offsets[k + 1]]
                docs.append(doc)
                mine.append(own)
                held, before = held + len(own), before + len(own)
        if mine:
            yield out()

    dealt = rows.join(F.broadcast(starts), "bucket").select("bucket", "id", "ids", "start")
    dealt.repartition("bucket").sortWithinPartitions("bucket", "id", "ids").mapInArrow(run, _BLOCK).write.parquet(f"{path}/blocks")


def _starts(sums: DataFrame) -> DataFrame:
    """(bucket, start): the sum of ``n`` over the buckets before, of which there are a few thousand at most."""
    rows = sorted(sums.collect())
    before = np.cumsum([0, *(r["n"] for r in rows)]).tolist()
    return sums.sparkSession.createDataFrame([(r["bucket"], start) for r, start in zip(rows, before, strict=False)], "bucket long, start long")


def _reading(spark: SparkSession, path: str, width: int, id_col: str, longest: int):
    """Batches of blocks to (id, start, packed ids)."""
    rows = spark.read.parquet(f"{path}/code").toArrow()
    ids, sizes, codes = canonical(dict(zip(rows["id"].to_pylist(), rows["length"].to_pylist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, size = decoding_table(ids, sizes, codes, longest)
        for row in (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
            n = np.array(row["sizes"], np.int64)
            own = unpack(row["bits"], np.array(row["checkpoints"], np.int64), int(n.sum()), symbol, size, longest)
            start = row["first_id"] + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start), _packed(own, n, width)], names=[id_col, "start", "ids"])

    return run


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCK).parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, width: int, id_col: str = "doc_id", longest: int = LONGEST) -> DataFrame:
    """(id, start, packed ids) of the documents in the file: start is the number of ids before. A file without blocks
    has no rows; bits that are no code raise."""
    return _blocks(spark, path).mapInArrow(_reading(spark, path, width, id_col, longest), f"{id_col} long, start long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) as read back from the file that this writes to ``path``.

    One row per row of ``docs``; null texts have the end id only; other columns are not read; an
    empty table makes an empty file.
    """
    spark, width = docs.sparkSession, id_width(tokenizer_path, end_id)
    encoded = written(token_ids(docs, tokenizer_path, end_id, id_col, text_col), "ids")
    write(encoded, path, width, id_col)
    removed(spark, encoded)
    back = _reading(spark, path, width, id_col, LONGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in back(batches):
            flat, offsets = unpacked(batch.column(2), width)
            flat = flat.astype("<u4")
            ends = offsets.tolist()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return _blocks(spark, path).mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids_crc32 long")
