"""CSV tables, file listings, images and their headers."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import ranged
from .ranged import Window

# EXIF tags of the sub-directory and of the focal length in 35 mm film.
_EXIF_IFD, _FILM_FOCAL = 0x8769, 0xA405


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Columns by place, whatever the header calls them; another number of columns raises."""
    n = len(spark.read.csv(path, header=True).columns)  # reads the header line only
    if n not in (0, len(schema)):
        raise ValueError(f"{path}: {n} columns, not {len(schema)}")
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True)


def below(root: str, path: Column) -> Column:
    """What of a file's path comes after ``root``, which may be written with or without its file system."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    start = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "", root).rstrip("/") + "/"
    return F.regexp_replace(bare, "^.*?" + re.escape(start), "")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below ``root``; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def film_focal(content: bytes) -> int | None:
    """EXIF's focal length in 35 mm film, from either of a JPEG's tag directories; None without."""
    at = content.find(b"Exif\0\0")
    if at < 0:
        return None
    tiff = content[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return None
    todo = [struct.unpack_from(order + "I", tiff, 4)[0]] if len(tiff) >= 8 else []
    seen: set[int] = set()
    while todo:
        ifd = todo.pop()
        if ifd in seen or ifd + 2 > len(tiff):
            continue
        seen.add(ifd)
        for k in range(struct.unpack_from(order + "H", tiff, ifd)[0]):
            entry = ifd + 2 + 12 * k
            if entry + 12 > len(tiff):
                break
            tag, kind = struct.unpack_from(order + "HH", tiff, entry)
            value = struct.unpack_from(order + ("H" if kind == 3 else "I"), tiff, entry + 8)[0]
            if tag == _FILM_FOCAL:
                return value
            if tag == _EXIF_IFD:
                todo.append(value)
    return None


def read_header(at: Window) -> tuple[int, int, int | None] | None:
    """(width, height, film focal) as a PNG's or JPEG's header has them, however far into the file; None for other or cut files.

    A JPEG's segments are walked by their lengths up to its pixels: only their first bytes and the tags are read.
    """
    start = at.get(0, 24)
    if start[:8] == b"\x89PNG\r\n\x1a\n" and start[12:16] == b"IHDR" and len(start) == 24:
        return *struct.unpack_from(">II", start, 16), None
    if start[:2] != b"\xff\xd8":
        return None
    place, size, focal = 2, None, None
    while True:
        head = at.get(place, 9)
        if len(head) < 4 or head[0] != 0xFF or head[1] in (0xD9, 0xDA):  # the pixels, or no segment
            break
        kind = head[1]
        if kind == 0xFF or kind == 1 or 0xD0 <= kind <= 0xD8:  # fill bytes, and markers without a length
            place += 1 if kind == 0xFF else 2
            continue
        length = struct.unpack_from(">H", head, 2)[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and len(head) == 9 and size is None:  # a frame's start
            height, width = struct.unpack_from(">HH", head, 5)
            size = width, height
        elif kind == 0xE1 and focal is None:
            focal = film_focal(at.get(place + 4, length - 2))
        place += 2 + length
    return None if size is None else (*size, focal)


def image_size(content: bytes) -> tuple[int, int] | None:
    """(width, height) of a whole file's bytes; None for other or cut files. No pixel is decoded."""
    found = read_header(Window(lambda n, at: content[at : at + n], len(content)))
    return found and found[:2]


_HEADER = "name string, width int, height int, film_focal int"
#: Files that a task's listing is read in at a time.
_LISTED = 1024


def _header_rows(names: list[str], headers: list[tuple | None]) -> pa.RecordBatch:
    schema = pa.schema([("name", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("film_focal", pa.int32())])
    rows = [(n, *h) for n, h in zip(names, headers, strict=True) if h and h[0] > 0]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def image_headers(spark: SparkSession, root: str) -> DataFrame:
    """(name, width, height, film_focal) of the PNG and JPEG files below ``root``; other files are left out.

    name: the path below ``root``, so two folders may hold files of one name. Tasks get ranges of the listing and read 64 KB
    of a file, more only where its header goes on behind them. Where only Spark knows the file system, files are read whole.
    """
    if ranged.scheme(root) not in ranged.SCHEMES:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    content = batch.column(1)[k].as_py()
                    yield _header_rows([batch.column(0)[k].as_py()], [read_header(Window(lambda n, at, c=content: c[at : at + n], len(content)))])

        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        return found.select(below(root, F.col("path")).alias("name"), "content").mapInArrow(whole, _HEADER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def header(path: str, size: int) -> tuple | None:
            with ranged.opened(path) as f:
                return read_header(Window(f.read_at, size))

        for batch in (b.slice(at, _LISTED) for b in batches for at in range(0, b.num_rows, _LISTED)):
            names, paths, sizes = (c.to_pylist() for c in batch.columns)
            yield _header_rows(names, [header(p, n) for p, n in zip(paths, sizes, strict=True)])

    names = listing(spark, root).select(below(root, F.col("path")).alias("name"), "path", "length")
    return names.repartition(F.xxhash64("path")).mapInArrow(run, _HEADER)


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """(origin, height, width, data): pixels in rows of red, green, blue. An unreadable file raises on use."""

    rows = spark.read.format("image").option("recursiveFileLookup", True).load(root).select("image.*")
    bad = F.raise_error(F.concat(F.lit("not an image: "), F.col("origin"))).cast("int")
    rows = rows.withColumn("width", F.when(F.col("width") > 0, F.col("width")).otherwise(bad))

    def rgb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # an image at a time
                pixels = np.frombuffer(batch.column(3)[k].as_py(), np.uint8).reshape(-1, batch.column(4)[k].as_py())
                own = (np.repeat(pixels, 3, axis=1) if pixels.shape[1] == 1 else pixels[:, 2::-1]).tobytes()
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(k, 1) for j in range(3)), pa.array([own], pa.binary())], names=["origin", "height", "width", "data"])

    return rows.select("origin", "height", "width", "data", "nChannels").mapInArrow(rgb, "origin string, height int, width int, data binary")
