"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into three segments. Two fingerprints within 4 bits differ by at most
one bit in some segment. On each segment the anchors are a covering code: the words whose low 15
bits are a Hamming(15, 11) codeword, any value above. Its covering radius is 1, so each value has
one home anchor within 1, and each value within 1 of it has that anchor within 2. Fingerprints go
to every anchor within radius + threshold = 2 of each segment and are compared, per anchor, with
those at home there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, pieces, written
from .components import components

THRESHOLD = 4
#: (lowest bit, width) of the segments: one more than THRESHOLD halves to 1 bit each.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
CODE_BITS = 15
#: Fingerprints at home at one anchor beyond which they are told apart by their other bits as well, and beyond which
#: what still stands together is split among tasks.
HOT_HOMES = 4096
#: Blocks of the other bits that are asked to be equal, by the homes of an anchor, in ``HOT_HOMES``.
BLOCK_LEVELS = (1, 1 << 9, 1 << 15)
#: Hot anchors are broadcast up to this many rows (16 bytes each), joined by shuffle beyond.
BROADCAST_ROWS = 100_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of one text as an unsigned number; 0 without words (null and empty texts too)."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 65536):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def simhash(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            found = [fingerprint(t, shingle) for part in pieces(column) for t in part.to_pylist()]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return id_text(docs, id_col, text_col).select(id_col, simhash(text_col).alias("fp"))


def _syndrome(value: Column) -> Column:
    bits = [sum(1 << i for i in range(CODE_BITS) if (i + 1) >> b & 1) for b in range(4)]
    parts = [F.shiftleft(F.bit_count(value.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)), b) for b, m in enumerate(bits)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def anchor_masks(width: int, syndrome: int, reach: int = 2) -> list[int]:
    """What to flip in a segment with this syndrome to get each anchor within ``reach``; its home first."""
    found = [()] if not syndrome else [(syndrome - 1,)] + [(i, j) for i, j in combinations(range(CODE_BITS), 2) if (i + 1) ^ (j + 1) == syndrome]
    free, masks = range(CODE_BITS, width), []
    for low in found:
        for k in range(reach - len(low) + 1):
            masks += [sum(1 << i for i in (*low, *high)) for high in combinations(free, k)]
    return masks


def _at_anchors(fps: DataFrame) -> DataFrame:
    """(k, fp, home): each fingerprint at each anchor within reach, all segments."""
    rows = []
    for n, (low, width) in enumerate(SEGMENTS):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in anchor_masks(width, s)]) for s in range(16)])
        rows.append(fps.select("fp", value.alias("x"), F.element_at(masks, _syndrome(value) + 1).alias("masks"), F.lit(n << 40).cast("long").alias("n")))
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.select("fp", "x", "n", F.posexplode("masks").alias("i", "mask")).select(
        F.col("x").bitwiseXOR(F.col("mask")).bitwiseOR(F.col("n")).alias("k"), "fp", (F.col("i") == 0).alias("home")
    )


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Merge the classes in ``label`` (each a root's index) of the ends of each edge."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _links(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, threshold: int, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, run by run of equal ``keys`` (sorted), of the pairs within ``threshold``."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    at = np.flatnonzero(home)
    run = np.searchsorted(starts, at, "right") - 1
    work = sizes[run]
    at, run, work = at[work > 1], run[work > 1], work[work > 1]
    label = np.arange(len(keys))
    # homes in pieces of about ``block`` comparisons, however long a run is
    cuts = np.cumsum(work) // block
    for piece in np.split(np.arange(len(at)), np.flatnonzero(np.diff(cuts)) + 1) if len(at) else []:
        w = work[piece]
        left = np.repeat(at[piece], w)
        right = np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(starts[run[piece]], w)
        near = np.bitwise_count(fps[left] ^ fps[right]) <= threshold
        near &= left != right
        _forest(left[near], right[near], label)
    child = np.flatnonzero(label != np.arange(len(keys)))
    return fps[child], fps[label[child]]


def block_masks(segment: int, equal: int) -> list[int]:
    """Of a segment's other bits, cut into ``THRESHOLD`` + ``equal`` blocks, any ``equal`` blocks, as signed 64-bit masks: two fingerprints within
    the threshold have the bits of one of these masks in common."""
    low, width = SEGMENTS[segment]
    others = [i for i in range(64) if not low <= i < low + width]
    blocks = THRESHOLD + equal
    bits = [sum(1 << i for i in others[len(others) * b // blocks : len(others) * (b + 1) // blocks]) for b in range(blocks)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(own) for own in combinations(bits, equal))]


def _told_apart(placed: DataFrame, hot: DataFrame) -> DataFrame:
    """(k, fp, home, hot): rows of ``hot`` anchors (k, homes) go to a key of their own for each mask, made of anchor and masked bits. Keys are
    hashes: where two are equal by chance more is compared, but nothing else linked."""

    def masks(equal: int) -> Column:
        every = F.array(*(F.array(*(F.lit(m).cast("long") for m in block_masks(n, equal))) for n in range(len(SEGMENTS))))
        return F.element_at(every, F.shiftright("k", 40).cast("int") + 1)

    level: Column = F.when(F.col("homes") > HOT_HOMES * BLOCK_LEVELS[2], masks(3)).when(F.col("homes") > HOT_HOMES * BLOCK_LEVELS[1], masks(2)).otherwise(masks(1))
    few = hot.count() <= BROADCAST_ROWS
    rows = placed.join(F.broadcast(hot) if few else hot, "k", "left")
    keys = F.transform(level, lambda m, i: F.xxhash64(F.col("k"), i, F.col("fp").bitwiseAND(m)))
    return rows.select(F.explode(F.when(F.col("homes").isNull(), F.array("k")).otherwise(keys)).alias("k"), "fp", "home", F.col("homes").isNotNull().alias("hot"))


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): edges between the distinct values of ``fps`` (fp) that connect just what pairs within
    ``threshold`` bits connect: per anchor a spanning forest, at most one edge for each copy there.

    ``threshold`` is at most 4, which the segments and the anchors' reach are made for.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"threshold must be 0 to {THRESHOLD}")
    spark = fps.sparkSession
    placed = _at_anchors(fps)
    counts = placed.where("home").groupBy("k").agg(F.count("*").alias("homes"))
    hot = written(counts.where(F.col("homes") > HOT_HOMES), "hot-anchors", rows=1)
    if hot.limit(1).count():
        placed = _told_apart(placed, hot)
        counts = placed.where("home and hot").groupBy("k").agg(F.count("*").alias("homes")).where(F.col("homes") > HOT_HOMES)
        still = written(counts.select("k", F.ceil(F.col("homes") / HOT_HOMES).cast("int").alias("parts")), "hot-anchors", rows=1)
        placed = placed.join(F.broadcast(still) if still.count() <= BROADCAST_ROWS else still, "k", "left")
        # the homes that stand together are dealt among parts; every part gets all others to compare with
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        placed = placed.select("k", "fp", "home", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))).alias("part"), own.alias("own"))
        placed = placed.select("k", "part", "fp", (F.col("home") & (F.col("own").isNull() | (F.col("own") == F.col("part")))).alias("home"))
    else:
        placed = placed.select("k", F.lit(0).alias("part"), "fp", "home")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # runs are sorted; a run that reaches over a batch's end waits for the next batch
        rest: list[pa.RecordBatch] = []

        def ends(batch: pa.RecordBatch) -> tuple[tuple, tuple]:
            return tuple((batch.column(0)[k].as_py(), batch.column(1)[k].as_py()) for k in (0, batch.num_rows - 1))

        def out(tables: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(tables).combine_chunks()
            k, part = t["k"].to_numpy(), t["part"].to_numpy()
            end = len(k) if last else int(np.flatnonzero((k != k[-1]) | (part != part[-1]))[-1]) + 1 if (k[0], part[0]) != (k[-1], part[-1]) else 0
            rest[:] = [] if end == len(k) else t.slice(end).to_batches()
            if end:
                key = np.cumsum(np.concatenate(([0], (k[1:end] != k[: end - 1]) | (part[1:end] != part[: end - 1]))))
                a, b = _links(key, t["fp"].to_numpy()[:end].view(np.uint64), t["home"].to_numpy()[:end], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            first, last = ends(batch)
            if rest and first == last == ends(rest[0])[0]:  # the run goes on: nothing is copied yet
                rest.append(batch)
            else:
                yield from out([*rest, batch], False)
        if rest:
            yield from out(list(rest), True)

    dealt = placed.repartition("k", "part").sortWithinPartitions("k", "part")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _least(fps: DataFrame, of: Column, threshold: int) -> DataFrame:
    """(f, least): for each distinct fingerprint the least ``of`` among the rows that links reach from it."""
    distinct = written(fps.groupBy("fp").agg(F.min(of).alias("own")), "classes")
    roots = components(links(distinct.select("fp"), threshold))
    class_root = distinct.join(roots, distinct["fp"] == roots["v"], "left").select("fp", F.coalesce("m", "fp").alias("root"), "own")
    least = class_root.groupBy("root").agg(F.min("own").alias("least"))
    return class_root.join(least, "root").select(F.col("fp").alias("f"), "least")


def groups(fps: DataFrame, id_col: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """``fps`` (id, fp) with component_id: the least id that links reach from the row's fingerprint.

    One row per input row. Rows of one fingerprint are one class, whatever their number, so exact
    copies cost nothing in the comparison. Null ids never become a component_id unless a
    component has no other.
    """
    named = _least(fps, F.col(id_col), threshold).withColumnRenamed("least", "component_id")
    return fps.join(named, fps["fp"] == named["f"]).drop("f")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, shingle: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``.

    Null and empty texts and texts without words have the fingerprint 0, linked like any other.
    Repeated rows come back as often as they came; other columns are not read. An empty table
    gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return groups(fps, id_col, threshold).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of least id, null being the greatest; of equal ids, that of least text hash.

    Rows are told apart by id and a 64-bit hash of the text (null texts are empty), so that texts
    which share an id, or have none, stay or go each by its own group.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    hashed = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), key.alias("hash")).alias("row"), text_col)
    fps = written(fingerprints(hashed, "row", text_col), "fingerprints")
    named = _least(fps, F.col("row"), THRESHOLD)
    lost = fps.join(named, fps["fp"] == named["f"]).where(F.col("row") != F.col("least")).select(F.col("row.id").alias("__id"), F.col("row.hash").alias("__lost")).distinct()
    rows = docs.withColumn("__hash", key)
    kept = rows.join(lost, rows[id_col].eqNullSafe(lost["__id"]) & (rows["__hash"] == lost["__lost"]), "left_anti")
    twice = fps.groupBy("row").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates([id_col, "__hash"]) if twice else kept).drop("__hash")
