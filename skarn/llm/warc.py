"""WARC files and a Merkle fixity audit of their replicas.

A leaf of the tree is a record: where it starts in its file, how long it is, and the digest of its
bytes. A node above stands for a range of offsets of the file, sixteen times as wide as its children's,
and digests them in order; above the files' roots nodes stand for ranges of files. Two replicas are
compared from their roots: only below nodes that differ are the children looked at, down to the
records that are lost, added, altered or moved.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, written

FANOUT = 16
#: Bytes of a file that a node right above the records stands for.
RANGE = 1 << 16
#: Ids to a file, and files that rows without an id are spread over.
FILE_IDS, NULL_FILES = 256, 256
#: Records of a piece of a file, which is read as one value.
PIECE = 10_000
#: Pieces whose starts (some 80 bytes each) are sent to all tasks; more are joined by shuffle.
BROADCAST_PIECES = 500_000
_CRLF = "\r\n"
_END = b"\r\n\r\n"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, warc_file, place, record): each row as a WARC resource record. Null urls and bodies are empty; a null
    id's record has no number and stands in a file below 0, told by its body. Other columns are not read.
    Rows that repeat an id stand in one file; ``place``, a hash of the url, deals them to its pieces."""
    body = F.coalesce(body_col, F.lit(""))
    head = [
        F.lit(f"WARC/1.0{_CRLF}WARC-Type: resource{_CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f">{_CRLF}WARC-Target-URI: "),
        F.coalesce(url_col, F.lit("")), F.lit(f"{_CRLF}Content-Type: text/html{_CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(_CRLF * 2),
    ]
    file = F.coalesce(F.expr(f"{id_col} div {FILE_IDS}"), -1 - F.pmod(F.xxhash64(url_col, body), F.lit(NULL_FILES)))
    return pages.select(id_col, file.cast("long").alias("warc_file"), F.xxhash64(F.coalesce(url_col, F.lit(""))).alias("place"), F.concat(*head, body, F.lit(_CRLF * 2)).alias("record"))


def write(recs: DataFrame, path: str, id_col: str = "page_id", compressed: bool = False) -> None:
    """WARC files ``path/warc_file=N/...``, records in order of id, then place, then bytes; ``compressed``: by gzip. A file is written in
    pieces, whose names are in its order: the records are sorted by ranges, so that a file of any size, also of one id, is
    many tasks' work, and a piece has ``PIECE`` records at most. Each ends with the separator that text files get. An empty table makes
    an empty folder. Compression is the fastest, as its time is a good part of the whole and the sorted records take more room than the files."""
    end = F.octet_length(F.lit(_CRLF * 2))
    keys = ["warc_file", id_col, "place"]
    lines = recs.select(*keys, F.substring(F.col("record"), F.lit(1), F.length("record") - end).alias("value"))
    dealt = lines.repartitionByRange(*keys).sortWithinPartitions(*keys, "value").select("warc_file", "value")
    dealt.write.partitionBy("warc_file").option("maxRecordsPerFile", PIECE).option("lineSep", _CRLF * 2).option("compression", "gzip" if compressed else "none").option("zlib.compress.level", "BEST_SPEED").text(path)


def _parsed(raw: bytes) -> Iterator[tuple[int, int, dict[str, str] | None]]:
    """(offset, length, header) of each record. What is no record, or is cut off, goes to the file's end without a header."""
    at = 0
    while at < len(raw):
        end, head = raw.find(_END, at), None
        try:
            lines = raw[at:end].decode("utf-8").split(_CRLF) if end >= 0 else []
            if lines and lines[0].startswith("WARC/"):
                head = dict(line.split(": ", 1) for line in lines[1:])
                end += 4 + int(head["Content-Length"])
                if not head["WARC-Record-ID"].startswith("<urn:page:") or "WARC-Target-URI" not in head or raw[end : end + 4] != _END or end < at:
                    head = None
                else:
                    int(_number(head) or 0)
        except (ValueError, KeyError):
            head = None
        size = end + 4 - at if head else len(raw) - at
        yield at, size, head
        at += size


def _number(head: dict[str, str]) -> str:
    return head["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, bytes]]:
    """(number of its file, name, bytes) of each piece, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            raw = batch.column(2)[k].as_py()
            yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def _files(spark: SparkSession, path: str) -> DataFrame:
    number = F.regexp_extract("path", "warc_file=(-?[0-9]+)", 1).cast("long")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(number.alias("warc_file"), F.element_at(F.split("path", "/"), -1).alias("piece"), "content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of the records in WARC files, each read as long as its header says. What is no record ends
    its file's reading without an error; ``scan`` tells where. An empty folder has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
        for _, _, raw in _contents(batches):
            out = []
            for at, size, head in _parsed(raw):
                if head:
                    n, number = int(head["Content-Length"]), _number(head)
                    body = raw[at + size - 4 - n : at + size - 4].decode("utf-8", "replace")
                    out.append({"page_id": int(number) if number else None, "url": head["WARC-Target-URI"], "html": body})
            yield pa.RecordBatch.from_pylist(out, schema)

    return _files(spark, path).mapInArrow(run, "page_id long, url string, html string")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """As ``scan``, with the piece that a record stands in, and its offset there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("warc_file", pa.int64()), ("piece", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_sha256", pa.string()), ("page_id", pa.int64()), ("whole", pa.bool_())])
        for file, name, raw in _contents(batches):
            out = []
            for at, size, head in _parsed(raw):
                number = _number(head) if head else ""
                out.append({"warc_file": file, "piece": name, "offset": at, "length": size, "record_sha256": hashlib.sha256(raw[at : at + size]).hexdigest(), "page_id": int(number) if number else None, "whole": head is not None})
            yield pa.RecordBatch.from_pylist(out, schema)

    return _files(spark, path).mapInArrow(run, "warc_file long, piece string, offset long, length long, record_sha256 string, page_id long, whole boolean")


def _placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` of ``_pieces`` with the offsets in their files: a piece starts where those before it end. ``by``: what tells folders apart. Only
    pieces that aren't their file's first are joined, by broadcast up to ``BROADCAST_PIECES``."""
    file = [*by, "warc_file"]
    sizes = rows.groupBy(*file, "piece").agg(F.max(F.col("offset") + F.col("length")).alias("size"))
    several = sizes.groupBy(*file).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    before = F.sum("size").over(Window.partitionBy(*file).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(sizes.join(several, file, "left_semi").select(*file, "piece", before.alias("start")).where("start > 0"), "pieces", rows=1)
    few = starts.limit(BROADCAST_PIECES + 1).count() <= BROADCAST_PIECES
    return rows.join(F.broadcast(starts) if few else starts, [*file, "piece"], "left").withColumn("offset", F.col("offset") + F.coalesce("start", F.lit(0))).drop("start", "piece")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(warc_file, offset, length, record_sha256, page_id, whole): the records where they stand. What is no record
    or is cut off is one row to its piece's end, not ``whole``."""
    return _placed(written(_pieces(spark, path), "scan"), []).select("warc_file", "offset", "length", "record_sha256", "page_id", "whole")


def _up(level: int, offset_levels: int) -> tuple[Column, Column]:
    """(file, slot) of the node above one at ``level``."""
    file, slot = F.col("file"), F.col("slot")
    if level == 0:
        return file, F.expr(f"slot div {RANGE}")
    return (file, F.expr(f"slot div {FANOUT}")) if level <= offset_levels else (F.expr(f"file div {FANOUT}"), F.lit(0).cast("long"))


def trees(leaves: DataFrame) -> tuple[list[DataFrame], int]:
    """The levels (replica, file, slot, digest) of both replicas' trees, from the records to the roots, and how many of
    them part a file by offsets. ``leaves``: (replica, warc_file, offset, length, record_sha256); a node has at most
    ``FANOUT`` children (a few hundred right above the records)."""
    own = F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "record_sha256").cast("binary"), 256)
    levels = [written(leaves.select("replica", F.col("warc_file").alias("file"), F.col("offset").alias("slot"), own.alias("digest")), "merkle")]
    low, high, last = levels[0].agg(F.min("file"), F.max("file"), F.max("slot")).first()
    offset_levels, wide = 0, (last or 0) // RANGE
    while wide > 0:
        offset_levels, wide = offset_levels + 1, wide // FANOUT
    children = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("file", "slot", "digest"))), lambda x: F.concat_ws(":", x["file"].cast("string"), x["slot"].cast("string"), x["digest"])))
    while low is not None and (len(levels) <= 1 + offset_levels or high > 0 or low < 0):
        if len(levels) > 1 + offset_levels:
            low, high = -(-low // FANOUT) if low < 0 else low // FANOUT, high // FANOUT  # as Spark divides
        file, slot = _up(len(levels) - 1, offset_levels)
        up = levels[-1].groupBy("replica", file.alias("upper"), slot.alias("place")).agg(F.sha2(children.cast("binary"), 256).alias("digest"))
        levels.append(written(up.select("replica", F.col("upper").alias("file"), F.col("place").alias("slot"), "digest"), "merkle"))
    return levels, offset_levels


def audit(levels: list[DataFrame], offset_levels: int) -> DataFrame:
    """(file, slot): where the replicas' records differ, told from the roots down; below equal nodes nothing is read."""

    def differing(rows: DataFrame) -> DataFrame:
        # both replicas have the node, and with one digest, if all is well
        return rows.groupBy("file", "slot").agg(F.count("*").alias("n"), F.min("digest").alias("x"), F.max("digest").alias("y")).where("n <> 2 or x <> y").select("file", "slot")

    bad = differing(levels[-1])
    for level in range(len(levels) - 2, -1, -1):
        parents = written(bad.toDF("upper", "place"), "mismatch")
        file, slot = _up(level, offset_levels)
        bad = differing(levels[level].withColumns({"upper": file, "place": slot}).join(parents, ["upper", "place"], "left_semi"))
    return bad


def fixity(spark: SparkSession, primary: str, replica: str) -> DataFrame:
    """(page_id, warc_file, offset, length, record_sha256, status) of the records in the WARC files below ``primary``, against ``replica``.

    status: 'intact' where the replica has the same bytes at the same place, else 'moved' if it has a record of
    this id and these bytes elsewhere, 'altered' if it has other records of this id only, 'lost' if none. Records of the replica
    whose id has no record in the primary are rows 'added', with the replica's places, and what is no record
    there is a row 'malformed' without an id (in the primary too). Rows that repeat an id are told apart by their bytes;
    records without an id count as one id. Empty folders: all of the other's records are lost or added.
    """
    both = _pieces(spark, primary).withColumn("replica", F.lit(False)).unionByName(_pieces(spark, replica).withColumn("replica", F.lit(True)))
    both = written(_placed(written(both, "pieces"), ["replica"]), "records")
    levels, offset_levels = trees(both)
    bad = written(audit(levels, offset_levels).toDF("f", "s"), "mismatch")
    differ = both.join(bad, (both["warc_file"] == bad["f"]) & (both["offset"] == bad["s"]), "left")
    columns = ["page_id", "warc_file", "offset", "length", "record_sha256"]
    a, b = (differ.where((F.col("replica") == r) & (F.col("f").isNotNull() if r else F.lit(True))) for r in (False, True))
    there = b.where("whole").select(F.col("page_id").alias("i"), F.col("record_sha256").alias("d")).distinct()
    ids = there.groupBy("i").agg(F.lit(True).alias("known"))
    found = a.join(there, a["page_id"].eqNullSafe(there["i"]) & (a["record_sha256"] == there["d"]) & a["f"].isNotNull(), "left").drop("i")
    found = found.join(ids, found["page_id"].eqNullSafe(ids["i"]) & found["f"].isNotNull(), "left")
    status = F.when(~F.col("whole"), "malformed").when(F.col("f").isNull(), "intact").when(F.col("d").isNotNull(), "moved").when(F.col("known"), "altered").otherwise("lost")
    here = both.where("not replica and whole").select(F.col("page_id").alias("i")).distinct()
    new = b.join(here, b["page_id"].eqNullSafe(here["i"]) & b["whole"], "left_anti")
    out = found.select(*columns, status.alias("status")).unionByName(new.select(*columns, F.when(F.col("whole"), "added").otherwise("malformed").alias("status")))
    return written(out, "fixity")


def compare(pages: DataFrame, copy: DataFrame, folder: str) -> DataFrame:
    """``fixity`` of two tables of pages, written as compressed WARC files below ``folder``, which are deleted in the end."""
    spark = pages.sparkSession
    for rows, name in ((pages, "primary"), (copy, "replica")):
        write(records(rows), f"{folder}/{name}", compressed=True)
    found = fixity(spark, f"{folder}/primary", f"{folder}/replica")
    dropped(spark, folder)
    return found


def damaged(pages: DataFrame, kind: Column, body_col: str = "html") -> DataFrame:
    """Pages with planted faults: where ``kind`` is 0 a character is put in the middle of the body, 1 the page is lost, 2 the body's end is cut."""
    body = F.coalesce(body_col, F.lit(""))
    half = F.expr(f"length(coalesce({body_col}, '')) div 2")
    bad = F.when(kind == 0, F.concat(F.substring(body, F.lit(1), half), F.lit("!"), F.substring(body, half + 1, F.length(body)))).when(kind == 2, F.substring(body, F.lit(1), half)).otherwise(body)
    return pages.where(F.coalesce(kind, F.lit(-1)) != 1).withColumn(body_col, bad)
