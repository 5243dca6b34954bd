"""Benchmark decontamination: a BM25 index of the test items, queried by every passage of every text.

A passage is a window of words; windows overlap so that each item that a text repeats lies whole
in one. The query's score for an item is taken as a share of the score that the item itself would
get, and block-max WAND retrieves every item whose share reaches the threshold: passages whose
terms' greatest weights can't add up to it are dropped first, then blocks of items, and the rest
are scored by pivoting on the posting lists. What is retrieved counts if the passage repeats the
five-word shingles of both the item's question and its answer, or as large a part of the item as a
whole. What has fewer words than a shingle must stand in the passage word by word.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, slices

K1, B = 1.2, 0.75
#: Share of an item's own score from which it is retrieved.
SHARE = 0.5
#: Shingles of the question, and of the answer, that the passage must hold.
OVERLAP, SHINGLE = 0.8, 5
#: Fewest words from one passage's start to the next; the longest item's if it is longer.
STRIDE = 64
#: Postings of the indexes that one pass over the texts takes to the tasks (some 100 MB); more items make more passes.
PASS_POSTINGS = 400_000
#: Items, and words of items, in one index on average; more make more indexes, each queried in turn.
SHARD_ITEMS, SHARD_WORDS = 1024, 1_000_000
#: Blocks of items in an index, and fewest items in one.
BLOCKS, BLOCK_ITEMS = 256, 4
#: Part of an item's words that are its answer where the table has no such column.
ANSWER_PART = 5
_SPACED = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words: what lies between ASCII characters that are neither letters nor digits."""
    return (text or "").lower().encode("utf-8").translate(_SPACED).split()


def shingles(w: list[bytes]) -> set[bytes]:
    """Five-word shingles; the whole sequence if it has fewer words."""
    return {b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def parts(text: str | None, answer: str | None = None) -> tuple[list[bytes], list[bytes]]:
    """Words of an item's question and answer; without an answer of its own, its last fifth, a shingle at least."""
    w = words(text)
    if answer is not None and (a := words(answer)):
        return w, a
    n = min(len(w) // 2, max(SHINGLE, len(w) // ANSWER_PART))
    return w[: len(w) - n], w[len(w) - n :]


def overlap(want: set[bytes], held: set[bytes], text: bytes) -> float:
    """Share of the shingles ``want`` that a passage holds; ``text``: its words with one blank before and after each."""
    if not want:
        return 1.0
    # one shingle alone can be shorter than the passage's
    return float(b" %b " % next(iter(want)) in text) if len(want) == 1 else len(held & want) / len(want)


def nearly(part: list[bytes], passage: list[bytes]) -> bool:
    """Whether a stretch of the passage is ``part`` but for one word in five (one, if it has three or more) put in, left out or replaced."""
    most = max(len(part) >= 3, len(part) // 5)
    edits = list(range(len(part) + 1))
    for w in passage:
        before, edits = edits, [0]
        for i, p in enumerate(part):
            edits.append(min(before[i] + (p != w), before[i + 1] + 1, edits[i] + 1))
        if edits[-1] <= most:
            return True
    return False


@dataclass
class Index:
    """Posting lists of one shard: items by number, weights as shares of each item's own score."""

    ids: list[int]
    questions: list[list[bytes]]
    replies: list[list[bytes]]
    own: list[bool]  # whether the answer is the item's own, not the end of its text
    asks: list[set[bytes]]
    answers: list[set[bytes]]
    stride: int
    term: dict[bytes, int] = field(default_factory=dict)
    items: list[list[int]] = field(default_factory=list)
    shares: list[list[float]] = field(default_factory=list)
    block: int = BLOCK_ITEMS
    known: pa.Array | None = None  # the terms by number
    block_most: np.ndarray | None = None  # by term and block


def verified(x: Index, item: int, passage: list[bytes], held: set[bytes], text: bytes) -> tuple[float, float] | None:
    """Overlaps with an item's question and answer if the passage repeats it, else None.

    Where the answer is the end of the item's text, the text as a whole counts as well, and it alone
    if a part has fewer words than a shingle. An answer of its own must be there beside the question:
    then the shingles of both count together if neither part has more than a few words changed.
    """
    ask, answer = overlap(x.asks[item], held, text), overlap(x.answers[item], held, text)
    question, reply = x.questions[item], x.replies[item]
    both = ask >= OVERLAP and answer >= OVERLAP
    if not x.own[item]:
        short = len(question) < SHINGLE or len(reply) < SHINGLE
        found = (both and not short) or overlap(shingles([*question, *reply]), held, text) >= OVERLAP
    else:
        asks, answers = len(x.asks[item]), len(x.answers[item])
        whole = ask * asks + answer * answers >= OVERLAP * (asks + answers) - 1e-9
        found = both or whole and all(o >= OVERLAP or nearly(part, passage) for o, part in ((ask, question), (answer, reply)))
    return (ask, answer) if found else None


def build(rows: list[tuple], counts: dict[bytes, int], total: int, average: float) -> Index:
    """``rows``: (id, question words, answer words, and whether the answer is the item's own; not if that is left out). ``counts``, ``total``, ``average``: of all items, in whatever shard."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1], r[2]))
    ids, asks, answers = ([r[k] for r in rows] for k in range(3))
    x = Index(ids, asks, answers, [any(r[3:]) for r in rows], [*map(shingles, asks)], [*map(shingles, answers)], max([STRIDE, *(len(r[1]) + len(r[2]) for r in rows)]))
    x.block = max(BLOCK_ITEMS, -(-len(rows) // BLOCKS))
    for n, (ask, answer) in enumerate(zip(asks, answers, strict=True)):
        tf, size = Counter([*ask, *answer]), len(ask) + len(answer)
        w = {t: np.log1p((total - counts[t] + 0.5) / (counts[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / average)) for t, f in tf.items()}
        own = sum(w.values())
        for t, v in w.items():
            k = x.term.setdefault(t, len(x.term))
            if k == len(x.items):
                x.items.append([])
                x.shares.append([])
            x.items[k].append(n)
            x.shares[k].append(float(v / own))
    blocks = -(-max(1, len(rows)) // x.block)
    x.block_most = np.zeros((len(x.items), blocks), np.float32)
    for k, (ns, vs) in enumerate(zip(x.items, x.shares, strict=True)):
        np.maximum.at(x.block_most[k], np.array(ns) // x.block, np.array(vs, np.float32))
    x.known = pa.array(x.term, pa.binary())
    return x


def wand(x: Index, terms: np.ndarray, share: float) -> Iterator[tuple[int, float]]:
    """(item, score) of each item that the distinct ``terms`` give ``share`` or more.

    Blocks whose greatest weights can't add up to the share are skipped. In the others cursors are
    sorted by their items; the pivot is the first at which the greatest weights so far reach the
    share: what stands before its item moves up to it, and an item that all reach is scored.
    """
    most = x.block_most[terms]
    for b in np.flatnonzero(most.sum(axis=0) >= share - 1e-4).tolist():
        first, end = b * x.block, (b + 1) * x.block
        here = np.flatnonzero(most[:, b])
        cursors = []
        for t, m in zip(terms[here].tolist(), most[here, b].tolist(), strict=True):
            n = bisect_left(x.items[t], first)
            cursors.append([x.items[t][n], n, t, m])
        while True:
            cursors.sort()
            bound, pivot = 1e-4, -1
            for i, c in enumerate(cursors):
                if c[0] >= end:
                    break
                bound += c[3]
                if bound >= share:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                s = sum(x.shares[c[2]][c[1]] for c in cursors if c[0] == item)
                if s >= share - 1e-9:
                    yield item, s
                item += 1
            for c in cursors:
                if c[0] >= item:
                    break
                own = x.items[c[2]]
                c[1] = n = bisect_left(own, item, c[1])
                c[0] = own[n] if n < len(own) else end


class Split:
    """Texts' words, told apart once for all indexes."""

    def __init__(self, texts: list[str | None]) -> None:
        self.words = [words(t) for t in texts]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.flat = pa.array(chain.from_iterable(self.words), pa.binary())


def _query(x: Index, texts: Split, share: float) -> Iterator[tuple[int, int, int, float, float, float]]:
    """(text's number, item's number, passage, score, overlaps) of what is verified."""
    # a little less than the share, as the bounds are sums of rounded weights
    least, stride, terms = share - 1e-4, x.stride, len(x.items)
    split, sizes = texts.words, texts.sizes
    pieces = np.maximum(1, -(-sizes // stride))
    first = np.cumsum(pieces) - pieces
    term = pc.index_in(texts.flat, value_set=x.known).fill_null(-1).to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(split)), sizes)
    piece = first[text] + (np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // stride
    at, term = np.divmod(np.unique((piece * terms + term)[term >= 0]), terms)
    total = int(pieces.sum())
    starts = np.searchsorted(at, np.arange(total + 1))
    bound = np.zeros((total, x.block_most.shape[1]), np.float32)
    step = max(1, (1 << 23) // x.block_most.shape[1])
    for k in range(0, len(at), step):
        own = at[k : k + step]
        heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        bound[own[heads]] += np.add.reduceat(x.block_most[term[k : k + step]], heads, axis=0)
    last = np.zeros(total, bool)
    last[first + pieces - 1] = True
    # a passage is two pieces, the text's last piece alone
    bound[:-1][~last[:-1]] += bound[1:][~last[:-1]]
    near = np.flatnonzero((bound >= least).any(axis=1))
    owner = np.searchsorted(first, near, "right") - 1
    for p, t in zip(near.tolist(), owner.tolist(), strict=True):
        mine = np.unique(term[starts[p] : starts[p + (1 if last[p] else 2)]])
        n = p - int(first[t])
        held = None
        for item, s in wand(x, mine, share):
            if held is None:
                passage = split[t][n * stride : (n + 2) * stride]
                held, joined = shingles(passage), b" %b " % b" ".join(passage)
            if both := verified(x, item, passage, held, joined):
                yield t, item, n, s, *both


def _indexes(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """One index after the other; only one shard of items is on the driver at a time."""
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), answer.alias("answer")).distinct()

    @F.pandas_udf("array<binary>")
    def both(text: pd.Series, answer: pd.Series) -> pd.Series:
        return pd.Series([[*q, *a] for q, a in (parts(t, None if pd.isna(b) else b) for t, b in zip(text, answer, strict=True))])

    rows = rows.withColumn("words", both("text", "answer")).where(F.size("words") > 0)
    total, average = rows.agg(F.count("*"), F.avg(F.size("words"))).first()
    if not total:
        return
    counted = rows.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    shards = max(-(-total // SHARD_ITEMS), int(total * average) // SHARD_WORDS + 1)
    for k in range(shards):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k)
        counts = counted.join(own.select(F.explode("words").alias("term")).distinct(), "term", "left_semi").toArrow()
        counts = dict(zip(counts["term"].to_pylist(), counts["n"].to_pylist(), strict=True))
        got = [(r["id"], *parts(r["text"], r["answer"]), bool(words(r["answer"]))) for r in own.select("id", "text", "answer").collect()]
        if got:
            yield build(got, counts, total, average)


def _groups(indexes: Iterator[Index]) -> Iterator[list[Index]]:
    """Indexes that are small enough together for one pass over the texts."""
    own, size = [], 0
    for x in indexes:
        n = sum(map(len, x.items))
        if own and size + n > PASS_POSTINGS:
            yield own
            own, size = [], 0
        own.append(x)
        size += n
    if own:
        yield own


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(id, item, passage, score, question_overlap, answer_overlap): one row for each text and item that it repeats.

    passage: number of the stretch of words at which the best passage starts; score: its BM25 score
    as a share of the item's own. Null and empty texts and items have no words and match nothing;
    repeated rows count once; other columns are not read, but for a column ``answer`` of the items,
    which then is what must be repeated beside the text. An overlap can be less than ``OVERLAP`` where
    the item as a whole reaches it. Empty tables give an empty result.
    """
    rows = id_text(docs, id_col, text_col)
    schema = T.StructType([rows.schema[id_col], T.StructField(item_col, items.schema[item_col].dataType), *(T.StructField(n, t) for n, t in (("passage", T.LongType()), ("score", T.DoubleType()), ("question_overlap", T.DoubleType()), ("answer_overlap", T.DoubleType())))])
    found = None
    for group in _groups(_indexes(items, item_col, item_text)):

        def run(batches: Iterator[pa.RecordBatch], indexes: list[Index] = group) -> Iterator[pa.RecordBatch]:
            target = pa.schema([pa.field(f.name, {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()]) for f in schema])
            for own in slices(batches, 1, 2048):
                ids, texts = own.column(0).to_pylist(), Split(own.column(1).to_pylist())
                got = [(ids[t], x.ids[i], n, s, a, b) for x in indexes for t, i, n, s, a, b in _query(x, texts, share)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), target, strict=True)], schema=target)

        some = rows.mapInArrow(run, schema)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    best = F.max_by(F.struct("passage", "score", "question_overlap", "answer_overlap"), F.struct(F.round("score", 12), -F.col("passage")))
    return found.groupBy(id_col, item_col).agg(best.alias("b")).select(id_col, item_col, "b.*")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the rows whose text repeats an item, whatever their ids; texts are told apart by a 64-bit hash."""
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    found = leaks(docs.select(key.alias("__leak"), text_col), items, "__leak", text_col, item_col).select("__leak").distinct()
    rows = docs.withColumn("__hash", key)
    return rows.join(found, rows["__hash"] == found["__leak"], "left_anti").drop("__hash")
