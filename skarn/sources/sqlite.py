"""Spark data source for SQLite scene files: ``spark.read.format("scene_sqlite").option("path", p).option("table", t)``.

Reading splits a table by ranges of its row ids (the whole-number primary key), one connection for
each; the options ``low`` and ``high`` read only that range of them. Filters are not pushed down: Spark
4.1 keeps a Python reader with the filters of a DataFrame's first query for its later ones. Writing
appends: each task leaves its rows in a file of its own beside the scene's, and once all have ended they
go into the table in one transaction, so a failed job or a task run twice adds nothing. The file
must be where the driver and every executor can open it; arrays are bytes here (``functions.blobs``).
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

_TYPES = {"INTEGER": LongType(), "INT": LongType(), "REAL": DoubleType(), "TEXT": StringType(), "BLOB": BinaryType()}

# The tables of a scene file.
DDL = """
CREATE TABLE IF NOT EXISTS cameras (camera_id INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, model INTEGER NOT NULL,
  width INTEGER NOT NULL, height INTEGER NOT NULL, params BLOB, prior_focal_length INTEGER NOT NULL);
CREATE TABLE IF NOT EXISTS images (image_id INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, name TEXT NOT NULL UNIQUE,
  camera_id INTEGER NOT NULL, prior_qw REAL, prior_qx REAL, prior_qy REAL, prior_qz REAL, prior_tx REAL, prior_ty REAL,
  prior_tz REAL, CONSTRAINT image_id_check CHECK(image_id >= 0 and image_id < 2147483647));
CREATE TABLE IF NOT EXISTS keypoints (image_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL, data BLOB);
CREATE TABLE IF NOT EXISTS descriptors (image_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL, data BLOB);
CREATE TABLE IF NOT EXISTS matches (pair_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL, data BLOB);
CREATE TABLE IF NOT EXISTS two_view_geometries (pair_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL,
  data BLOB, config INTEGER NOT NULL, F BLOB, E BLOB, H BLOB);
CREATE UNIQUE INDEX IF NOT EXISTS index_name ON images(name);
"""


def create_tables(path: str) -> None:
    with sqlite3.connect(path) as db:
        db.executescript(DDL)
    db.close()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class _Part(WriterCommitMessage):
    path: str


@dataclass
class _Range(InputPartition):
    low: int
    high: int


class SceneReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.parts = int(options.get("partitions", "8"))
        self.bounds = int(options.get("low", -(1 << 63))), int(options.get("high", (1 << 63) - 1))

    def partitions(self):
        db = sqlite3.connect(self.path)
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", self.bounds).fetchone()
        db.close()
        if low is None:
            return [_Range(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(x, min(high, x + step - 1)) for x in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        columns = ", ".join(_quoted(n) for n in self.schema.fieldNames())
        db = sqlite3.connect(self.path)
        try:
            yield from db.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
        finally:
            db.close()


class SceneWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names, self.path, self.table = schema.fieldNames(), options["path"], options["table"]

    def write(self, iterator) -> WriterCommitMessage:
        part = f"{self.path}.part-{uuid.uuid4().hex}"
        columns = ", ".join(map(_quoted, self.names))
        with sqlite3.connect(part) as db:
            db.execute(f"CREATE TABLE part ({columns})")
            db.executemany(f"INSERT INTO part VALUES ({', '.join('?' * len(self.names))})", ([bytes(v) if isinstance(v, bytearray) else v for v in row] for row in iterator))
        db.close()
        return _Part(part)

    def commit(self, messages) -> None:
        """SQLite copies the tasks' tables itself, first all into one, then that in one transaction; no row passes through Python."""
        columns = ", ".join(map(_quoted, self.names))
        parts = [m.path for m in messages if m is not None]
        try:
            for target, name, sources in [(parts[0], "part", parts[1:]), (self.path, self.table, parts[:1])] if parts else []:
                db = sqlite3.connect(target, timeout=600, isolation_level=None)
                try:
                    for source in sources:
                        db.execute("ATTACH ? AS tasks", (source,))
                        db.execute(f"INSERT INTO main.{_quoted(name)} ({columns}) SELECT {columns} FROM tasks.part")
                        db.execute("DETACH tasks")
                finally:
                    db.close()
        finally:
            self.abort(messages)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class SceneSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scene_sqlite"

    def schema(self) -> StructType:
        db = sqlite3.connect(self.options["path"])
        found = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        db.close()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return StructType([StructField(n, _TYPES[t.upper()]) for _, n, t, *_ in found])

    def reader(self, schema: StructType) -> SceneReader:
        return SceneReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> SceneWriter:
        if overwrite:
            raise ValueError("scene_sqlite only appends")
        return SceneWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SceneSource)
