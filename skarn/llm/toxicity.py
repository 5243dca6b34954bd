"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The texts' n-grams are hashed to buckets. Over the training documents each bucket's log-count
ratio r says how much likelier toxic documents hold it. The buckets of largest evidence are the
features, present (1) or not (0), times r; a logistic regression is fitted on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import id_text, pieces, slices, written

BUCKET_BITS = 20
LENGTHS = (3, 4, 5, 6)
FEATURES = 4096
#: Labelled documents that a model is fitted on, those of least hashed id: the bound of what fitting costs.
TRAINING_ROWS = 24_000
#: Added to every bucket's count in either class.
SMOOTHING = 1.0
#: Fewest training documents that hold a feature.
LEAST_DOCUMENTS = 4
#: Characters hashed at a time.
BLOCK = 1 << 20
_PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Model:
    """weight[bucket]: what the bucket's presence adds to the logit (0: no feature)."""

    weight: np.ndarray
    intercept: float


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text between blanks, with runs of white space as one blank."""
    return np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), np.uint32)


def _buckets(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams, block by block, one array for each n."""
    most = max(LENGTHS)
    for at in range(0, len(codes), BLOCK):
        c = codes[at : at + BLOCK + most - 1].astype(np.uint64)
        h = np.zeros(len(c), np.uint64)
        for n in range(1, most + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] + c[n - 1 :] * np.uint64(_PRIMES[n - 1])
            if n in LENGTHS:
                x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
                yield (x[:BLOCK] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


class _Presence:
    """Which buckets a text holds, of those asked for."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BUCKET_BITS, bool)

    def of(self, text: str, wanted: np.ndarray | None = None) -> np.ndarray:
        found = []
        for b in _buckets(_codes(text)):
            b = b if wanted is None else b[wanted[b]]
            b = b[~self.seen[b]]
            self.seen[b] = True
            found.append(b)
        held = np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)
        self.seen[held] = False
        return held


def bounded(labelled: DataFrame, id_col: str, rows: int = TRAINING_ROWS) -> DataFrame:
    """At most ``rows`` rows, those of least hashed id: a fixed choice, whatever the partitions."""
    return labelled.orderBy(F.xxhash64(id_col), id_col).limit(rows)


def log_count_ratios(train: DataFrame, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket its ratio r and the number of training documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, presence = np.zeros((2, 1 << BUCKET_BITS), np.int64), _Presence()
        for part in slices(batches, 0):
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                sums[y][presence.of(text)] += 1
        b = np.flatnonzero(sums.any(axis=0))
        for at in range(0, len(b), 65536):
            x = b[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(sums[0][x]), pa.array(sums[1][x])], names=["bucket", "clean", "toxic"])

    parts = train.select(text_col, F.col(label_col).cast("int")).mapInArrow(count, "bucket long, clean long, toxic long")
    # at most 2 ** BUCKET_BITS rows, however many documents
    rows = parts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST_DOCUMENTS).toArrow()
    counts = np.zeros((2, 1 << BUCKET_BITS))
    bucket = rows["bucket"].to_numpy()
    counts[0][bucket], counts[1][bucket] = rows["clean"].to_numpy(), rows["toxic"].to_numpy()
    p, q = counts[1] + SMOOTHING, counts[0] + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum()), counts[0] + counts[1]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS, features: int = FEATURES) -> Model:
    """A model from labelled texts, at most ``rows`` of them. Rows without a label don't count; null texts are empty.

    With no labelled row at all every score is 0.5; with one class only, its rate among the rows.
    """
    train = written(bounded(labelled.where(F.col(label_col).isNotNull()), id_col, rows).select(F.coalesce(text_col, F.lit("")).alias(text_col), F.col(label_col).cast("double").alias("label")), "labelled")
    # a few partitions even of one small file, as n-grams cost more than reading
    train = train.repartition(12)
    n, toxic = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    weight = np.zeros(1 << BUCKET_BITS, np.float32)
    if toxic in (0, n):
        return Model(weight, float(np.log((toxic + 0.5) / (n - toxic + 0.5))) if n else 0.0)
    ratio, held = log_count_ratios(train, text_col, "label")
    # evidence of presence: how far a bucket moves the logit, by how many documents it moves
    evidence = np.abs(ratio) * np.sqrt(held)
    chosen = np.sort(np.argsort(-evidence, kind="stable")[:features])
    chosen = chosen[evidence[chosen] > 0]
    place = np.full(1 << BUCKET_BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    wanted, scale = place >= 0, ratio[chosen]
    size = len(chosen)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = _Presence()
        for part in slices(batches, 1):
            at = [np.sort(place[presence.of(t, wanted)]) for t in part.column(1).to_pylist()]
            offsets = pa.array(np.cumsum([0, *map(len, at)]), pa.int32())
            flat, n = np.concatenate([*at, np.empty(0, np.int32)]), len(at)
            places, values = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (flat.astype(np.int32), scale[flat]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), places, values], names=["label", "type", "size", "indices", "values"])

    points = train.select("label", text_col).mapInArrow(vectors, "label double, type tinyint, size int, indices array<int>, values array<double>")
    # a sparse vector's own fields: written as such, they are read as vectors
    points = written(points.select("label", F.struct("type", "size", "indices", "values").alias("features")), "vectors", StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())]))
    lr = LogisticRegression(maxIter=60, regParam=1e-4, elasticNetParam=0.0, standardization=False).fit(points)
    weight[chosen] = lr.coefficients.toArray() * scale
    return Model(weight, float(lr.intercept))


def score(text: Column, model: Model) -> Column:
    """Probability that a text is toxic, from all its characters; null as the empty text."""
    index = np.flatnonzero(model.weight).astype(np.int32)
    values, intercept = model.weight[index], model.intercept

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weight = np.zeros(1 << BUCKET_BITS, np.float32)
        weight[index] = values
        wanted, presence = weight != 0, _Presence()
        for column in texts:
            x = [intercept + float(weight[presence.of(t, wanted)].sum(dtype=np.float64)) for part in pieces(column) for t in part.to_pylist()]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(x, np.float64), -500, 500))))

    return scores(F.coalesce(text, F.lit("")))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True for the fold that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS) -> DataFrame:
    """Texts with labels outside the held-out fold. The ids are chosen before the texts are read, so
    at most ``rows`` ids meet the documents."""
    known = labels.select(id_col, label_col).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(id_col))
    chosen = bounded(known.groupBy(id_col).agg(F.max(label_col).alias(label_col)), id_col, rows)
    return id_text(docs, id_col, text_col).join(F.broadcast(chosen), id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``docs``.

    Null texts score as empty ones. A document labelled twice counts once, toxic if either says so.
    Null ids aren't held out and never learnt from. Other columns are not read; an empty table
    gives an empty result.
    """
    model = fit(training_rows(docs, labels, id_col, text_col, label_col), id_col, text_col, label_col)
    scored = docs.select(id_col, held_out(id_col).alias("held_out"), score(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
