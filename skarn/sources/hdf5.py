"""Keypoints and matches from HDF5 files as a data source, where h5py is installed; else as (name, kps) and (name1, name2, matches) tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_SCHEMAS = {"keypoints": "name string, kps array<array<float>>", "matches": "name1 string, name2 string, matches array<array<int>>"}
_ARROW = {
    "keypoints": pa.schema([("name", pa.string()), ("kps", pa.list_(pa.list_(pa.float32())))]),
    "matches": pa.schema([("name1", pa.string()), ("name2", pa.string()), ("matches", pa.list_(pa.list_(pa.int32())))]),
}
#: Bytes of datasets in a batch; one that is longer is a batch of its own.
BATCH_BYTES = 1 << 22


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs h5py; write the features as Parquet and pass the tables instead") from e
    return h5py


@dataclass
class _Range(InputPartition):
    """Datasets by their numbers: the group to start in, how many datasets of it to pass over, and how many to read from there."""

    group: int
    skip: int
    n: int


def ranges(sizes: Iterator[int], parts: int, total: int) -> list[_Range]:
    """Groups of so many datasets in up to ``parts`` equal ranges, which begin and end anywhere within a group."""
    step = max(1, -(-total // parts))
    out, start, at = [], None, 0  # at: datasets before the group
    for g, size in enumerate(sizes):
        while len(out) * step < at + size and len(out) * step < total:
            start = len(out) * step
            out.append(_Range(g, start - at, min(step, total - start)))
        at += size
    return out


class FeatureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.kind, self.parts = options["path"], options["kind"], int(options.get("partitions", "8"))

    def partitions(self):
        """Only the groups' sizes are looked at; no name is kept."""
        with _h5py().File(self.path, "r") as f:
            if self.kind == "keypoints":
                return ranges(iter([len(f)]), self.parts, len(f)) or [_Range(0, 0, 0)]
            total = sum(len(f[n]) for n in f)
            return ranges((len(f[n]) for n in f), self.parts, total) or [_Range(0, 0, 0)]

    def _datasets(self, f, part: _Range) -> Iterator[tuple]:
        if self.kind == "keypoints":
            yield from ((n, f[n]) for n in islice(iter(f), part.skip, part.skip + part.n))
            return
        left, skip = part.n, part.skip
        for name in islice(iter(f), part.group, None):
            if left <= 0:
                return
            for other in islice(iter(f[name]), skip, skip + left):
                yield name, other, f[name][other]
                left -= 1
            skip = 0

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        schema, rows, size = _ARROW[self.kind], [], 0
        with _h5py().File(self.path, "r") as f:
            for *names, data in self._datasets(f, partition):
                values = np.asarray(data[()])
                if rows and size + values.nbytes > BATCH_BYTES:
                    yield self._batch(rows, schema)
                    rows, size = [], 0
                rows.append((*names, values.tolist()))
                size += values.nbytes
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class FeatureSource(DataSource):
    """Options: path; kind, "keypoints" (datasets by name) or "matches" (groups of datasets by names); partitions."""

    @classmethod
    def name(cls) -> str:
        return "scene_hdf5"

    def schema(self) -> str:
        return _SCHEMAS[self.options["kind"]]

    def reader(self, schema: StructType) -> FeatureReader:
        return FeatureReader(self.options)


def _load(spark: SparkSession, path: str, kind: str, parts: int) -> DataFrame:
    _h5py()  # else the error comes from a task
    spark.dataSource.register(FeatureSource)
    return spark.read.format("scene_hdf5").option("path", path).option("kind", kind).option("partitions", parts).load()


def keypoints(spark: SparkSession, path: str, parts: int = 8) -> DataFrame:
    """(name, kps): the file's datasets, ranges of them dealt to tasks."""
    return _load(spark, path, "keypoints", parts)


def matches(spark: SparkSession, path: str, parts: int = 8) -> DataFrame:
    """(name1, name2, matches): the datasets of the file's groups, in equal ranges however they are spread over the groups."""
    return _load(spark, path, "matches", parts)
