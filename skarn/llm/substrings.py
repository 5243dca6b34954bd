"""Removal of every byte that a repeated long string covers, over all texts.

Any ``LENGTH`` bytes hold a least hashed ``GRAM``-byte string, the leftmost of equals: the window's
anchor, which equal windows share. So texts meet by the anchors' hashes alone. A run of windows
with one anchor lies in a context of bytes; equal contexts are counted before they are compared,
which settles copies however many there are. Of contexts that share an anchor but differ, one of
each goes to a suffix array, where equal windows are neighbours. Anchors with very many different
contexts go by the windows' hashes instead, which spreads them over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, joined_by_key, removed, slices, written
from .suffixes import suffix_array

LENGTH, GRAM = 400, 100
#: Different contexts of one anchor up to which they are sorted together; beyond, windows are hashed.
SORTED_CONTEXTS = 48
#: Texts that a broadcast of their keys (16 bytes each) may name; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes searched for anchors at a time.
BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
#: What tells texts apart.
TEXT = ["t1", "t2"]
_ANCHOR = "t1 long, t2 long, gram long, c1 long, c2 long, a int, run int"


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, those of its inverse, and a random number for each byte."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(BLOCK + 2 * LENGTH, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1], np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)


_TABLES: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _grams(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at each place."""
    if not _TABLES:
        _TABLES.append(_powers())
    power, inverse, value = _TABLES[0]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[raw] * power[: len(raw)], dtype=np.uint64)))
    h = (sums[size:] - sums[:-size]) * inverse[: len(raw) - size + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _runs(raw: bytes) -> Iterator[tuple[int, int, int]]:
    """(gram hash, first, last): for each anchor the windows that it is the anchor of."""
    width, mask = LENGTH - GRAM + 1, np.uint64((1 << 20) - 1)
    for at in range(0, len(raw) - LENGTH + 1, BLOCK):
        h = _grams(np.frombuffer(raw, np.uint8)[at : at + BLOCK + LENGTH - 1])
        n = len(h) - width + 1
        # the hash's upper bits, then the place: the least is the leftmost of equals
        key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        tiles = np.concatenate((key, np.full(-len(key) % width, np.iinfo(np.uint64).max))).reshape(-1, width)
        left = np.minimum.accumulate(tiles, axis=1).reshape(-1)
        right = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        anchor = (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & mask).astype(np.int64)
        heads = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        yield from zip(h[anchor[heads]].view(np.int64).tolist(), (heads + at).tolist(), (np.append(heads[1:], n) - 1 + at).tolist(), strict=True)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, t1, t2, text): two 64-bit hashes tell texts apart, whatever their ids."""
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(LENGTH), text).alias("t2"), text.alias("text"))


def copies(rows: DataFrame) -> DataFrame:
    """(t1, t2, n, one): texts that more rows than one have, how many, and the least of their ids. All their windows are repeated."""
    return rows.where(F.octet_length("text") >= LENGTH).groupBy(*TEXT).agg(F.count("*").alias("n"), F.min("doc").alias("one")).where("n > 1")


def anchors(rows: DataFrame) -> DataFrame:
    """(t1, t2, gram, c1, c2, a, run): each anchor's hash, its context's 128 bits, its first window and how many follow.

    A text that a task meets again and again has two rows for each anchor there: more would tell nothing more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], int] = {}
        for batch in slices(batches, 3, 1024):
            out: list[list[int]] = [[] for _ in range(7)]
            for t1, t2, text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                raw = text.encode("utf-8")
                if len(raw) < LENGTH:
                    continue
                times = met[t1, t2] = met.get((t1, t2), 0) + 1
                if times > 2:
                    continue
                for gram, a, b in _runs(raw):
                    c = xxhash.xxh3_128_intdigest(raw[a : b + LENGTH])
                    for column, x in zip(out, (t1, t2, gram, (c >> 64) - (1 << 63), (c & (1 << 64) - 1) - (1 << 63), a, b - a), strict=True):
                        column.append(x)
            types = [pa.int64()] * 5 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["t1", "t2", "gram", "c1", "c2", "a", "run"])

    return rows.mapInArrow(run, _ANCHOR)


def _few(keys: DataFrame) -> bool:
    return keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _of(rows: DataFrame, keys: DataFrame, how: str, hot: DataFrame | None = None) -> DataFrame:
    """``rows`` whose text is (left_semi) or isn't (left_anti) among ``keys`` (t1, t2). ``hot``: for left_anti, texts of very many rows, which are
    left out by broadcast first."""
    if _few(keys):
        return rows.join(F.broadcast(keys), TEXT, how)
    return (rows if hot is None else rows.join(F.broadcast(hot), TEXT, "left_anti")).join(keys, TEXT, how)


def _once_a_task(rows: DataFrame) -> DataFrame:
    """(t1, t2, text), each text once for each task that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in slices(batches, 2, 1024):
            new = []
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key not in met:
                    met.add(key)
                    new.append(k)
            yield batch if len(new) == batch.num_rows else batch.take(pa.array(new, pa.int64()))

    return rows.select("t1", "t2", "text").mapInArrow(run, "t1 long, t2 long, text string")


def _contexts(rows: DataFrame, wanted: DataFrame, again: DataFrame) -> DataFrame:
    """``wanted`` (t1, t2, gram, c1, c2, a, run, once, wide) with the bytes of each context. Of the texts in ``again`` (copies) the rows of
    the least id are asked, and those once a task, so a context may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 256):
            out = []
            for text, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = text.encode("utf-8")
                out += [x | {"bytes": raw[x["a"] : x["a"] + x["run"] + LENGTH]} for x in own]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("gram", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("run", pa.int32()), ("once", pa.bool_()), ("wide", pa.bool_()), ("bytes", pa.binary())]))

    lists = written(wanted.groupBy(*TEXT).agg(F.collect_list(F.struct("gram", "c1", "c2", "a", "run", "once", "wide")).alias("list")), "lists")
    keys = lists.select(*TEXT).join(again.select(*TEXT, "one"), TEXT, "left").select(*TEXT, F.col("one").alias("first_id"), F.lit(True).alias("there"))
    asked = rows.join(F.broadcast(keys) if _few(keys) else keys, TEXT).where(F.col("first_id").isNull() | (F.col("doc") == F.col("first_id")))
    return _once_a_task(asked).join(lists, TEXT).select(*TEXT, "text", "list").mapInArrow(run, "gram long, c1 long, c2 long, run int, once boolean, wide boolean, bytes binary")


def _equal_windows(contexts: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each context the ranges of its windows that another window among them equals.

    Windows whose hash no other has can't be equal to any. What holds the others is sorted, and
    equal windows follow each other in that order.
    """
    # all contexts at once; a window over the end of one counts for nothing
    joined = np.frombuffer(b"".join(contexts), np.uint8)
    runs = [len(raw) - LENGTH + 1 for raw in contexts]
    ends = np.cumsum([len(raw) for raw in contexts])
    inside = np.concatenate([np.arange(n) + e - len(raw) for raw, n, e in zip(contexts, runs, ends, strict=True)])
    hashes = _grams(joined, LENGTH)[inside]
    order = np.sort(hashes)
    again = order[1:][order[1:] == order[:-1]]
    some = np.isin(hashes, again)
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    symbols: list[int] = []
    starts, text, at = {}, b"", 0
    for k, (raw, n) in enumerate(zip(contexts, runs, strict=True)):
        places = np.flatnonzero(some[at : at + n]).tolist()
        at += n
        if places:
            starts |= {len(text) + i - places[0]: (k, i) for i in places}
            part = raw[places[0] : places[-1] + LENGTH]
            text += part + b"\0"
            symbols += [*(x + len(contexts) for x in part), k]  # each end differs from all else
    if not starts:
        return found
    equal: list[set[int]] = [set() for _ in contexts]
    order = [i for i in suffix_array(symbols) if i in starts]
    for x, y in zip(order, order[1:], strict=False):
        if text[x : x + LENGTH] == text[y : y + LENGTH]:
            for i in (x, y):
                equal[starts[i][0]].add(starts[i][1])
    return [_ranges(sorted(f)) for f in equal]


def _ranges(places: list[int]) -> list[tuple[int, int]]:
    return [((own := [x for _, x in part])[0], own[-1]) for _, part in groupby(enumerate(places), lambda p: p[1] - p[0])]


_PART = "gram long, c1 long, c2 long, first int, last int"
_PART_ARROW = pa.schema([("gram", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def _sorted_groups(contexts: DataFrame) -> DataFrame:
    """(gram, c1, c2, first, last): windows, counted from the context's first, that another context of the anchor holds.
    Contexts that come more than once take part, but have no rows: all their windows are known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r["gram"], r) for b in batches for at in range(0, b.num_rows, 256) for r in b.slice(at, 256).to_pylist())
        for gram, own in groupby(rows, lambda x: x[0]):
            group: list[dict] = []
            for _, r in own:  # a context that comes more than once counts once here
                if not group or (r["c1"], r["c2"]) != (group[-1]["c1"], group[-1]["c2"]):
                    group.append(r)
            found = _equal_windows([r["bytes"] for r in group])
            out = [{"gram": gram, "c1": r["c1"], "c2": r["c2"], "first": x, "last": y} for r, ranges in zip(group, found, strict=True) if r["once"] for x, y in ranges]
            if out:
                yield pa.RecordBatch.from_pylist(out, _PART_ARROW)

    return contexts.repartition("gram").sortWithinPartitions("gram", "c1", "c2").mapInArrow(run, _PART)


def _hashed_groups(contexts: DataFrame) -> DataFrame:
    """As ``_sorted_groups``, by 128-bit hashes of all the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            out = []
            for r in batch.to_pylist():
                for i in range(r["run"] + 1):
                    out.append({"gram": r["gram"], "c1": r["c1"], "c2": r["c2"], "once": r["once"], "place": i, "window": xxhash.xxh3_128_digest(r["bytes"][i : i + LENGTH])})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("gram", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("once", pa.bool_()), ("place", pa.int32()), ("window", pa.binary())]))

    windows = written(contexts.mapInArrow(run, "gram long, c1 long, c2 long, once boolean, place int, window binary"), "windows")
    twice = windows.groupBy("window").agg(F.count("*").alias("all"), F.count_if("once").alias("n"))
    twice = written(twice.where("all > 1 and n > 0").select("window", "n"), "twice")
    return joined_by_key(windows.where("once"), twice, ["window"]).select("gram", "c1", "c2", F.col("place").alias("first"), F.col("place").alias("last"))


def repeated(rows: DataFrame, again: DataFrame) -> DataFrame:
    """(t1, t2, first, last): ranges of places at which a string of LENGTH bytes starts that starts elsewhere too, in texts that one row has;
    those of more are ``again``, and repeated as a whole."""
    every = written(anchors(rows), "anchors")
    shared = every.groupBy("gram").agg(F.count("*").alias("n"), F.min("c1").alias("x"), F.max("c1").alias("y")).where("n > 1")
    shared = written(shared.select("gram", "n", (F.col("x") != F.col("y")).alias("several")), "grams")
    some = written(joined_by_key(every, shared, ["gram"]), "shared")
    context = ["gram", "c1", "c2"]
    distinct = some.groupBy(*context).agg(F.count("*").alias("n"), F.min(F.struct(*TEXT, "a", "run")).alias("one"), F.first("several").alias("several"))
    distinct = written(distinct.select(*context, "n", "one.*", "several"), "contexts")
    whole = distinct.where("n > 1").select(*context, "n", F.lit(0).alias("first"), F.col("run").alias("last"))
    open_ = distinct.where("several").withColumn("once", F.col("n") == 1).drop("n", "several")
    sizes = written(open_.groupBy("gram").agg(F.count("*").alias("n")).withColumn("wide", F.col("n") > SORTED_CONTEXTS), "sizes")
    bytes_ = written(_contexts(rows, joined_by_key(open_, sizes, ["gram"]), again), "bytes")
    more = _sorted_groups(bytes_.where("not wide")).unionByName(_hashed_groups(bytes_.where("wide")))
    parts = written(whole.unionByName(more.select(*context, F.lit(1).cast("long").alias("n"), "first", "last")), "parts")
    alone = _of(some, again.select(*TEXT), "left_anti")
    found = joined_by_key(alone, parts, context).select(*TEXT, (F.col("a") + F.col("first")).alias("first"), (F.col("a") + F.col("last")).alias("last"))
    found = written(found, "repeats")
    for table in (every, shared, some, distinct, sizes, bytes_, parts):
        removed(rows.sparkSession, table)
    return found


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept binary, n_bytes, n_removed, n_spans) for each row of ``docs``.

    kept: the UTF-8 bytes of the text without each byte that a string of LENGTH bytes covers which
    starts anywhere else too, in the same text or another; judged on the texts as they came. Null
    and empty texts have no bytes. Rows with equal texts are each other's repeats, whatever their ids, which may be
    null or repeat. Other columns are not read. Ids must be whole numbers (or null).
    """
    rows = _keyed(docs, id_col, text_col)
    again = written(copies(rows), "copies")
    found = repeated(rows, again)
    raw, size = F.col("text").cast("binary"), F.octet_length("text").cast("long")
    none = F.lit(0).cast("long")
    hot = again.orderBy(F.desc("n")).limit(HOT_KEYS).select(*TEXT)
    touched = again.select(*TEXT).unionByName(found.select(*TEXT).distinct())
    plain = _of(rows, touched, "left_anti", hot).select("doc", raw.alias("kept"), size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"))
    copied = joined_by_key(rows, again, TEXT) if not _few(again) else rows.join(F.broadcast(again.select(*TEXT)), TEXT)
    copied = copied.select("doc", F.lit(b"").alias("kept"), size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])
        for batch in slices(batches, 1, 256):
            out = []
            for doc, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = text.encode("utf-8")
                kept, at, spans, start, end = [], 0, 0, -1, -1
                for first, last in sorted((x["first"], x["last"]) for x in ranges):
                    if first > end:
                        if end >= 0:
                            kept.append(own[at:start])
                            at, spans = end, spans + 1
                        start = first
                    end = max(end, last + LENGTH)
                kept += [own[at:start], own[end:]]
                left = b"".join(kept)
                out.append({"doc": doc, "kept": left, "n_bytes": len(own), "n_removed": len(own) - len(left), "n_spans": spans + 1})
            yield pa.RecordBatch.from_pylist(out, schema)

    # a text here is one row's, and its list is as long as the text at most
    lists = written(found.groupBy(*TEXT).agg(F.collect_list(F.struct("first", "last")).alias("list")), "lists")
    cut = _of(rows, lists.select(*TEXT), "left_semi").join(lists, TEXT).select("doc", "text", "list")
    cut = cut.mapInArrow(run, "doc long, kept binary, n_bytes long, n_removed long, n_spans long")
    return plain.unionByName(copied).unionByName(cut).withColumnRenamed("doc", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return without_repeats(docs, id_col, text_col).select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
