"""Importance resampling towards a target: documents whose hashed n-grams look like the target's are drawn first.

Texts are bytes in UTF-8, and words are cut at bytes, which are never part of a longer character.
A long text is split at word boundaries into chunks that any task may take. A chunk owns the words that
start in it and carries the next n - 1, so that each run of words is counted once, where it starts. A
document's counts and gains are its chunks' sums. The draw is without replacement, by Gumbel noise that
a document's id fixes.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, removed, written

#: Buckets that features are hashed to, longest run of words, factor of a gain's whole number.
BUCKETS, LONGEST, SCALE = 10_000, 1, 1000
#: Documents of fewer words aren't drawn; of the others so many of a hundred are. What noise starts from.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Bytes of a text from which it is split, and of a chunk (to the end of its last word).
CHUNK_BYTES = 1 << 15
#: Distinct words whose hash a worker remembers, and the longest of them in bytes.
WORDS, WORD_BYTES = 200_000, 40
# What words are made of, in bytes of UTF-8.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def chunks(raw: bytes, longest: int = LONGEST, size: int = 0) -> Iterator[tuple[bytes, bytes]]:
    """(own, carried): the text in pieces that end at word boundaries, each with what holds the next ``longest`` - 1 words."""
    size = size or CHUNK_BYTES
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, at + size) if at + size < len(raw) else None
        end = gap.start() if gap else len(raw)
        after = end
        for _ in range(longest - 1):
            word = _WORD.search(raw, after)
            if word is None:
                break
            after = word.end()
        yield raw[at:end], raw[end:after]
        at = end


def features(own: bytes, carried: bytes, longest: int, known: dict[bytes, int], buckets: int) -> tuple[int, list[int]]:
    """The words that start in a chunk, and the bucket of each run of 1 to ``longest`` words from there. ``known``: hashes of words seen before."""
    words = own.translate(_LOWER).split()
    n = len(words)
    if longest == 1:
        out = []
        for w in words:
            b = known.get(w)
            if b is None:
                b = zlib.crc32(w) % buckets
                if len(known) < WORDS and len(w) <= WORD_BYTES:
                    known[w] = b
            out.append(b)
        return n, out
    words += carried.translate(_LOWER).split()
    out = []
    for k in range(n):
        h = zlib.crc32(words[k])
        out.append(h % buckets)
        for w in words[k + 1 : k + longest]:
            h = zlib.crc32(w, zlib.crc32(b" ", h))  # goes on where the shorter run ended
            out.append(h % buckets)
    return n, out


def _parts(docs: DataFrame, text_col: str, id_col: str | None, longest: int) -> DataFrame:
    """(id, d1, d2, first, own, carried): texts as a whole, and long ones in chunks dealt to all tasks. ``d1``, ``d2``: a digest of the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select((F.lit(None) if id_col is None else F.col(id_col)).cast("long").alias("id"), text.alias("text"))
    schema = pa.schema([("id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("first", pa.bool_()), ("own", pa.binary()), ("carried", pa.binary())])
    size = CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(1), 1024):
                out: list[tuple] = []
                for number, text in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts.to_pylist(), strict=True):
                    raw = text.encode("utf-8")
                    d = xxhash.xxh3_128_intdigest(raw)
                    key = number, (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)
                    if len(raw) <= size:
                        out.append((*key, True, raw, b""))
                    else:
                        for k, part in enumerate(chunks(raw, longest, size)):
                            out.append((*key, k == 0, *part))
                            if len(out) >= 256:
                                yield _batch(out, schema)
                                out = []
                at += len(texts)
                if out:
                    yield _batch(out, schema)

    kind = "id long, d1 long, d2 long, first boolean, own binary, carried binary"
    long_ = F.octet_length("text") > size
    dealt = rows.where(long_).mapInArrow(run, kind).repartition("id", "d1", "d2", F.xxhash64("own", "carried"))
    return rows.where(~long_).mapInArrow(run, kind).unionByName(dealt)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of features in each bucket over all rows; a row for each task and bucket is shuffled, and a row for each bucket collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own, carried in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                total += np.bincount(np.array(features(own, carried, longest, known, buckets)[1], np.int64), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    found = _parts(docs, text_col, None, longest).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the floored, scaled log of how much likelier it is in the target than in the source, one added to each count."""
    s, t = int(source.sum()), int(target.sum())
    n = len(source)
    return np.array([math.floor(SCALE * math.log((int(y) + 1) * (s + n) / ((int(x) + 1) * (t + n)))) for x, y in zip(source, target, strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(id, d1, d2, copies, n_words, n_features, weight): one row for the rows that share an id and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            words, sizes, sums = [], [], []
            for own, carried in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                n, found = features(own, carried, longest, known, len(gain))
                words.append(n)
                sizes.append(len(found))
                sums.append(int(gain[found].sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pc.cast(batch.column(3), pa.int64()), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["id", "d1", "d2", "copies", "n_words", "n_features", "gain"])

    parts = _parts(docs, text_col, id_col, longest).mapInArrow(run, "id long, d1 long, d2 long, copies long, n_words long, n_features long, gain long")
    sums = parts.groupBy("id", "d1", "d2").agg(*(F.sum(c).alias(c) for c in ("copies", "n_words", "n_features", "gain")))
    one = {c: F.expr(f"{c} div copies") for c in ("n_words", "n_features", "gain")}  # equal rows have equal chunks
    return sums.withColumns(one).withColumn("weight", F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features")).cast("long")).drop("gain")


def noise(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise, scaled and floored, that the id fixes; a null id counts as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -float(SCALE)).cast("long")


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (id, d1, d2, copies, n_words, score, ...) with ``rank``, of a group's copies the first one's; null where none is drawn.

    The rows are sorted by ranges in all tasks and written; a range's ranks start from the copies in the ranges before it, so no
    task sees more than its range.
    """
    spark = scored.sparkSession
    able = F.col("n_words") >= least_words
    total = scored.where(able).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    most = total * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("d1"), F.asc("d2")]
    # the lowest score that is surely drawn from: ranks are given to rows from there on only
    by_score = scored.where(able).groupBy(F.expr("score div 64").alias("step")).agg(F.sum("copies").alias("n"))
    steps = written(by_score, "score-steps", rows=1)
    low, left = None, most
    for step, n in steps.orderBy(F.desc("step")).collect():  # a 64th of the range of scores
        low, left = step, left - n
        if left <= 0:
            break
    removed(spark, steps)
    if not most or low is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    some = scored.where(able & (F.expr("score div 64") >= low)).select("id", "d1", "d2", "copies", "score")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(some.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("part").agg(F.sum("copies").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    own = F.sum("copies").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies")
    ranked = ranges.withColumn("own", own).join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("rank", F.col("own") + F.col("before") + 1)
    ranked = ranked.where(F.col("rank") <= most).select(F.col("id").alias("i"), F.col("d1").alias("x"), F.col("d2").alias("y"), "rank")
    return scored.join(ranked, F.col("id").eqNullSafe(F.col("i")) & (F.col("d1") == F.col("x")) & (F.col("d2") == F.col("y")), "left").drop("i", "x", "y").withColumn("most", F.lit(most))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of ``docs``, drawn towards the texts of ``target``.

    weight: floored mean of the gains of the text's runs of 1 to ``longest`` words, 0 without any. rank: 1, 2, 3... by score, then id
    (null ids last), then text; null where the row isn't drawn. Null and empty texts have no words. Rows that repeat an id and a
    text are ranked one after the other. An empty target adds one to each bucket only; an empty table has no rows. Texts are
    taken whole, however long, and other columns are not read. Ids must be whole numbers (or null).
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    found = weights(docs, gain, id_col, text_col, longest)
    scored = written(found.withColumn("score", F.col("weight") + noise("id")), "scores")
    ranked = drawn(scored)
    if "most" not in ranked.columns:
        ranked = ranked.withColumn("most", F.lit(0))
    out = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    place = F.col("rank") + F.col("copy")
    out = written(out.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(place <= F.col("most"), place).alias("rank")), "drawn")
    removed(spark, scored)
    return out
