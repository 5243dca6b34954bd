"""Tables as Parquet folders in versions that a manifest names: appends, deletes on read, skipped files, checked keys.

A version's manifest lists for each table its folders, its deletes and the next number that it gives out.
Rows are sorted by ranges of the table's first key when they are written, and each file's least and greatest
key is kept, so that a read by key opens the files that can hold it. A delete writes keys, not tables: it
holds for the folders that were there before it, and readers leave those keys out until ``compact`` folds
deletes and small folders into new ones. Of the keys of a folder either a list (few) or a Bloom filter in
blocks (many) is kept beside it; an append tests its keys against those and joins only suspects with old files.

A manifest is created, never overwritten. Who loses the race for a version takes the winner's as its base,
checks its keys against what that added, and tries again. Readers keep what they read until ``vacuum``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import hadoop

#: Keys of a folder or a delete, and files of a folder, that a manifest lists itself; more stand in a table of their own.
INLINE_KEYS, INLINE_FILES = 1000, 100
#: Rows of a file, and keys that a read sends to all tasks (8 bytes each); more are joined by shuffle.
FILE_ROWS, BROADCAST_KEYS = 1_000_000, 1_000_000
#: Small folders (``INLINE_KEYS`` rows at most) and deletes of a table from which a write compacts them.
SMALL_FOLDERS, DELETES = 32, 32
#: A Bloom filter's block: bits, bits set for a key, and keys that it is made for.
BLOCK_BITS, KEY_BITS, BLOCK_KEYS = 1024, 5, 80
#: Times that a lost race is run again, and times and seconds that a manifest is waited for which another writer has begun.
RETRIES, WAITS, WAIT_S = 20, 10, 0.2


class ConstraintError(ValueError):
    """A write would break a key, a range or a shape."""


def none_of(df: DataFrame, bad: Column, message: str) -> None:
    """Raise if any row is ``bad``."""
    found = df.where(bad).limit(1).collect()
    if found:
        raise ConstraintError(f"{message}: {found[0].asDict()}")


def _places(key: str, blocks: int) -> tuple[Column, list[Column]]:
    """A key's block, and the bits that it sets there."""
    return F.pmod(F.xxhash64(key), F.lit(blocks)), [F.pmod(F.xxhash64(F.col(key), F.lit(j + 1)), F.lit(BLOCK_BITS)).cast("int") for j in range(KEY_BITS)]


def bloom_blocks(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, words): the bits that the keys of each block set, 64 to a word."""
    block, places = _places(key, blocks)
    flat = rows.select(block.alias("block"), *(p.alias(f"p{j}") for j, p in enumerate(places)))
    words = [F.bit_or(F.expr(" | ".join(f"if(p{j} div 64 = {w}, shiftleft(1L, p{j} % 64), 0L)" for j in range(KEY_BITS)))).alias(f"w{w}") for w in range(BLOCK_BITS // 64)]
    return flat.groupBy("block").agg(*words).select("block", F.array(*(f"w{w}" for w in range(BLOCK_BITS // 64))).alias("words"))


def suspects(rows: DataFrame, key: str, filters: DataFrame, blocks: int) -> DataFrame:
    """(key): those whose bits are all set in one of ``filters`` (block, words); no key that was put in is missing."""
    block, places = _places(key, blocks)
    asked = rows.select(key, block.alias("block"), *(p.alias(f"p{j}") for j, p in enumerate(places)))
    there = F.expr(" AND ".join(f"(shiftright(words[cast(p{j} div 64 AS int)], p{j} % 64) & 1L) = 1L" for j in range(KEY_BITS)))
    return asked.join(filters, "block").where(there).select(key).distinct()


def _overlap(x: Sequence | None, y: Sequence | None) -> bool:
    return bool(x and y) and x[0] <= y[1] and y[0] <= x[1]


class VersionedTables:
    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, StructType], unique: Mapping[str, Sequence[str]]) -> None:
        """``unique``: of each table the columns that no two rows share; by the first, a whole number, its rows are kept in order."""
        self.spark, self.root, self.schemas, self.unique = spark, root.rstrip("/"), schemas, unique
        self._open: dict | None = None  # the state within a transaction
        self._log: list[tuple] = []  # what the transaction does
        self._made: list[str] = []  # folders that it has written

    # --- versions --------------------------------------------------------------------------------

    def _stored(self) -> dict:
        """The last version. A manifest that is cut off is waited for; if it stays so, as its writer died, it counts as the version before."""
        names = [n for n in hadoop.children(self.spark, f"{self.root}/manifests") if n.endswith(".json")]
        for k, name in enumerate(reversed(names)):
            for _ in range(1 if k else WAITS):
                try:
                    return json.loads(hadoop.read_text(self.spark, f"{self.root}/manifests/{name}")) | {"version": int(names[-1].removesuffix(".json"))}
                except ValueError:
                    time.sleep(WAIT_S)
        return {"version": int(names[-1].removesuffix(".json")) if names else -1, "tables": {}}

    def _manifest(self, name: str) -> dict:
        """A manifest, empty if it is cut off."""
        try:
            return json.loads(hadoop.read_text(self.spark, f"{self.root}/manifests/{name}"))
        except ValueError:
            return {"tables": {}}

    def _state(self) -> dict:
        """{"version", "tables": {name: {"folders", "deletes", "next_id", "clock"}}} as it is now."""
        return self._stored() if self._open is None else self._open

    def exists(self) -> bool:
        return self._state()["version"] >= 0

    def _last(self, table: str) -> dict:
        found = self._state()["tables"].get(table)
        if found is None:
            raise ValueError(f"{self.root} has no table {table}; create_tables() makes it")
        return found

    def next_id(self, table: str) -> int:
        """The number that the table gives out next."""
        return self._last(table)["next_id"]

    @contextmanager
    def transaction(self, source: str | None = None, number: int = 0) -> Iterator[bool]:
        """All writes within become visible to others together at the end; if anything raises, none does, and its files go.

        ``source``: who writes, and the number of what it writes. The version says the last number of each source; one that isn't
        greater was written before, so False is given, and nothing that is written then counts.
        """
        if self._open is not None:  # within another one
            if source is not None:
                raise ValueError("a numbered transaction can't be within another one")
            yield True
            return
        self._open, self._log, self._made = self._stored(), [], []
        try:
            new = source is None or self._open.get("sources", {}).get(source, -1) < number
            if new and source is not None:
                self._apply("number", source, number)
            yield new
            if new:
                self._publish()
            else:
                self._clear()
        except BaseException:
            self._clear()
            raise
        finally:
            self._open, self._log, self._made = None, [], []

    def _clear(self) -> None:
        for path in self._made:
            hadoop.remove(self.spark, path)

    def _publish(self) -> None:
        for attempt in range(RETRIES + 1):
            if not self._log:
                return
            version = self._open["version"] + 1
            try:
                hadoop.create_text(self.spark, f"{self.root}/manifests/{version:010d}.json", json.dumps(self._open | {"version": version}))
                return
            except Exception:
                now = self._stored()
                if now["version"] < version or attempt == RETRIES:  # not for another writer's sake
                    raise
            self._rebase(now)

    def _rebase(self, now: dict) -> None:
        """What this transaction does, on another writer's version: its keys are checked against what that has and ours hadn't."""
        log, before = self._log, self._open
        self._open, self._log = now, []
        if any(kind == "number" and now.get("sources", {}).get(source, -1) >= what[0] for kind, source, *what in log):
            return self._clear()  # another attempt at the same has won
        for kind, table, *what in log:
            if kind == "create":
                if table not in self._open["tables"]:
                    self._apply(kind, table, *what)
            elif kind == "append":
                entry, next_id, checked = what
                if checked:
                    known = {f["name"] for f in before["tables"][table]["folders"]}
                    new = self._read(table, [entry["name"]])
                    for key in self.unique[table]:
                        self._none_there(table, new, key, entry, [f for f in self._last(table)["folders"] if f["name"] not in known])
                self._apply(kind, table, entry, max(next_id, self.next_id(table)), checked)
            elif kind == "swap":  # its rows are as our base had them; the folders that it folded stay instead
                self._forget(table, what[1])
            else:
                self._apply(kind, table, *what)

    def _apply(self, kind: str, table: str, *what) -> None:
        """Do one step on the open state, and keep it in the log."""
        self._log.append((kind, table, *what))
        if kind == "number":
            self._open = self._open | {"sources": self._open.get("sources", {}) | {table: what[0]}}
            return
        if kind == "create":
            new = {"folders": [], "deletes": [], "next_id": 1, "clock": 0}
        else:
            last = self._open["tables"][table]
            clock = last["clock"] + 1
            if kind == "append":
                entry, next_id, _ = what
                new = last | {"folders": [*last["folders"], entry | {"at": clock}], "next_id": next_id, "clock": clock}
            elif kind == "delete":
                new = last | {"deletes": [*last["deletes"], what[0] | {"at": clock}], "clock": clock}
            else:  # "swap": folders for one that has their rows as they were then
                gone, entry, then = what
                new = last | {"folders": [*(f for f in last["folders"] if f["name"] not in gone), *([entry | {"at": then}] if entry["rows"] else [])]}
            new = new | {"deletes": [d for d in new["deletes"] if any(self._holds(d, f, table) for f in new["folders"])]}
        self._open = self._open | {"tables": self._open["tables"] | {table: new}}

    def create_tables(self, *tables: str) -> None:
        """Empty tables, all by default; those that exist stay as they are."""
        with self.transaction():
            for t in tables or self.schemas:
                if t not in self._open["tables"]:
                    self._apply("create", t)

    def vacuum(self, versions: int = 1) -> None:
        """Delete the files that none of the last ``versions`` versions names, and older manifests. No other writer may be at work."""
        names = [n for n in hadoop.children(self.spark, f"{self.root}/manifests") if n.endswith(".json")]
        kept: dict[str, set[str]] = {}
        good = [n for n in names if self._manifest(n)["tables"]]
        names = good if good else names
        for n in names[-versions:]:
            for table, state in self._manifest(n)["tables"].items():
                own = kept.setdefault(table, set())
                for f in state["folders"]:
                    own |= {f["name"], *(b["name"] for b in f.get("blooms", {}).values()), *([f["stats"]] if "stats" in f else [])}
                own |= {d["name"] for d in state["deletes"] if "name" in d}
        for table in self.schemas:
            for folder in hadoop.children(self.spark, f"{self.root}/{table}"):
                if folder not in kept.get(table, ()):
                    hadoop.remove(self.spark, f"{self.root}/{table}/{folder}")
        for n in names[:-versions]:
            hadoop.remove(self.spark, f"{self.root}/manifests/{n}")

    # --- reads -----------------------------------------------------------------------------------

    def _read(self, table: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schemas[table]).parquet(*(f"{self.root}/{table}/{p}" for p in paths))

    def _holds(self, delete: dict, folder: dict, table: str) -> bool:
        """Whether a delete may be about a folder's rows."""
        return delete["at"] > folder["at"] and _overlap(delete["range"], folder["ranges"][self.unique[table][0]])

    def _without(self, table: str, rows: DataFrame, deletes: list[dict]) -> DataFrame:
        key = self.unique[table][0]
        few = sorted({k for d in deletes for k in d.get("keys", ())})
        if few:
            rows = rows.where(~F.col(key).isin(few))
        for d in deletes:
            if "name" in d:
                keys = self.spark.read.schema(StructType([self.schemas[table][key]])).parquet(f"{self.root}/{table}/{d['name']}")
                rows = rows.join(F.broadcast(keys) if d["rows"] <= BROADCAST_KEYS else keys, key, "left_anti")
        return rows

    def _rows(self, table: str, chosen: list[tuple[dict, list[str]]]) -> DataFrame:
        """The rows that live in the given (folder, paths); folders with the same deletes are read together."""
        deletes = self._last(table)["deletes"]
        own = [([d for d in deletes if self._holds(d, f, table)], paths) for f, paths in chosen if paths]
        own.sort(key=lambda x: [d["at"] for d in x[0]])
        out = None
        for _, group in groupby(own, key=lambda x: [d["at"] for d in x[0]]):
            members = list(group)
            rows = self._without(table, self._read(table, [p for _, paths in members for p in paths]), members[0][0])
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], self.schemas[table]) if out is None else out

    def table(self, name: str) -> DataFrame:
        return self._rows(name, [(f, [f["name"]]) for f in self._last(name)["folders"]])

    def _files(self, folder: dict, table: str, keys: Sequence[int]) -> list[str]:
        """Paths of the folder's files that may hold one of the keys, which are in order."""
        own = folder["ranges"][self.unique[table][0]]
        near = [k for k in keys if _overlap((k, k), own)]
        if not near:
            return []
        if "stats" in folder:
            stats = self.spark.read.parquet(f"{self.root}/{table}/{folder['stats']}")
            asked = F.array(*map(F.lit, near))
            found = [r["file"] for r in stats.where((F.col("low") <= near[-1]) & (F.col("high") >= near[0]) & F.exists(asked, lambda k: (k >= F.col("low")) & (k <= F.col("high")))).select("file").collect()]
        else:
            found = [f for f, low, high in folder["files"] if any(low <= k <= high for k in near)]
        return [f"{folder['name']}/{f}" for f in found]

    def rows_by_key(self, table: str, keys: Sequence[int]) -> DataFrame:
        """Rows with one of a few keys; only files whose range holds one are opened."""
        asked = sorted(set(keys))
        rows = self._rows(table, [(f, self._files(f, table, asked)) for f in self._last(table)["folders"]])
        return rows.where(F.col(self.unique[table][0]).isin(asked))

    # --- writes ----------------------------------------------------------------------------------

    def _new(self, table: str, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        self._made.append(f"{self.root}/{table}/{name}")
        return name

    def _forget(self, table: str, entry: dict) -> None:
        """Delete the files of a folder that no version names."""
        for name in (entry["name"], entry.get("stats"), *(b["name"] for b in entry.get("blooms", {}).values())):
            if name:
                hadoop.remove(self.spark, f"{self.root}/{table}/{name}")

    def _save(self, table: str, df: DataFrame, constants: Mapping[str, Column] = {}) -> str:
        """Sort and write rows; ``constants``, which take next to nothing in a shuffle but their full size in a sort, are put in behind it."""
        name, key = self._new(table, "data"), self.unique[table][0]
        rows = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[table] if f.name not in constants])
        rows = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)
        rows = rows.select([constants.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in self.schemas[table]])
        rows.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.root}/{table}/{name}")
        return name

    def _described(self, table: str, name: str, bad: Mapping[str, Column] = {}) -> dict:
        """A folder's entry: rows, ranges of its keys, its files' ranges, and its keys or filters of them. Raises where a required value is null, a
        row is ``bad``, or a key repeats."""
        keys = self.unique[table]
        new = self._read(table, [name])
        nulls = F.exists(F.array(*(F.col(f.name).isNull() for f in self.schemas[table] if not f.nullable)), lambda x: x)
        rules = {f"{table}: a required value is null": nulls} | {f"{table}: {k}": v for k, v in bad.items()}
        marks = [F.count_if(v).alias(f"bad{k}") for k, v in enumerate(rules.values())]
        bounds = [f(k).alias(f"{n}{j}") for j, k in enumerate(keys) for f, n in ((F.min, "low"), (F.max, "high"))]
        by_file = new.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"), *bounds, *marks)
        found = by_file.limit(INLINE_FILES + 1).collect()
        entry: dict = {"name": name}
        if len(found) > INLINE_FILES:
            entry["stats"] = self._new(table, "stats")
            by_file.withColumns({"low": F.col("low0"), "high": F.col("high0")}).coalesce(8).write.parquet(f"{self.root}/{table}/{entry['stats']}")
            stats = self.spark.read.schema(by_file.select("*", F.col("low0").alias("low"), F.col("high0").alias("high")).schema).parquet(f"{self.root}/{table}/{entry['stats']}")
            found = stats.agg(F.sum("rows").alias("rows"), *(f(f"{n}{j}").alias(f"{n}{j}") for j in range(len(keys)) for f, n in ((F.min, "low"), (F.max, "high"))), *(F.sum(f"bad{k}").alias(f"bad{k}") for k in range(len(rules)))).collect()
        else:
            entry["files"] = [[r["file"], r["low0"], r["high0"]] for r in found if r["low0"] is not None]
        for k, (message, rule) in enumerate(rules.items()):
            if sum(r[f"bad{k}"] for r in found):
                none_of(new, rule, message)
        entry["rows"] = sum(r["rows"] for r in found)
        entry["ranges"] = {k: [min(r[f"low{j}"] for r in found), max(r[f"high{j}"] for r in found)] if entry["rows"] else None for j, k in enumerate(keys)}
        if entry["rows"] <= INLINE_KEYS:
            values = new.select(*keys).collect() if entry["rows"] else []
            entry["keys"] = {k: [r[k] for r in values] for k in keys}
            for k in keys:
                if len(set(entry["keys"][k])) < len(values):
                    raise ConstraintError(f"{table}: {k} repeats")
        else:
            entry["blooms"] = {}
            blocks = 1 << ((entry["rows"] - 1) // BLOCK_KEYS).bit_length()
            for k in keys:
                none_of(new.groupBy(k).count(), F.col("count") > 1, f"{table}: {k} repeats")
                bloom = self._new(table, "bloom")
                bloom_blocks(new, k, blocks).write.parquet(f"{self.root}/{table}/{bloom}")
                entry["blooms"][k] = {"name": bloom, "blocks": blocks}
        return entry

    def _none_there(self, table: str, new: DataFrame, key: str, entry: dict, folders: list[dict]) -> None:
        """Raise if a key of ``new`` is among the live rows of ``folders``. Files are read only where a list or filter of their keys has one of it."""
        near = [f for f in folders if _overlap(entry["ranges"][key], f["ranges"][key])]
        inline = {k for f in near if "keys" in f for k in f["keys"][key]}
        kind = StructType([self.schemas[table][key]])
        found: list[DataFrame] = []
        if inline and "keys" in entry:
            both = sorted(inline & set(entry["keys"][key]))
            if both:
                found.append(self.spark.createDataFrame([(k,) for k in both], kind))
        elif inline:
            found.append(new.select(key).join(F.broadcast(self.spark.createDataFrame([(k,) for k in sorted(inline)], kind)), key, "left_semi"))
        large = sorted((f for f in near if "blooms" in f), key=lambda f: f["blooms"][key]["blocks"])
        for blocks, group in groupby(large, key=lambda f: f["blooms"][key]["blocks"]):
            filters = self.spark.read.schema("block long, words array<long>").parquet(*(f"{self.root}/{table}/{f['blooms'][key]['name']}" for f in group))
            found.append(suspects(new, key, filters, blocks))
        if not found:
            return
        doubtful = found[0]
        for more in found[1:]:
            doubtful = doubtful.unionByName(more)
        low, high, n = doubtful.agg(F.min(key), F.max(key), F.count("*")).first()
        if not n:
            return
        some = [f for f in near if _overlap((low, high), f["ranges"][key])]
        if key == self.unique[table][0] and n <= INLINE_KEYS:
            asked = sorted({r[0] for r in doubtful.collect()})
            live = self._rows(table, [(f, self._files(f, table, asked)) for f in some])
        else:
            live = self._rows(table, [(f, [f["name"]]) for f in some])
        none_of(live.select(key).join(doubtful.distinct(), key, "left_semi"), F.lit(True), f"{table}: {key} exists")

    def append(self, table: str, df: DataFrame, number: str | None = None, bad: Mapping[str, Column] = {}, checked: bool = True, constants: Mapping[str, Column] = {}) -> None:
        """Add rows. ``number``: the column that the next number follows; ``bad``: rules that no row may meet; ``checked``: keys may not be there yet;
        ``constants``: values of columns that are the same in all rows."""
        with self.transaction():
            last = self._last(table)
            entry = self._described(table, self._save(table, df, constants), bad)
            if checked:
                new = self._read(table, [entry["name"]])
                for key in self.unique[table]:
                    self._none_there(table, new, key, entry, last["folders"])
            next_id = last["next_id"]
            if number and entry["rows"]:
                next_id = max(next_id, entry["ranges"][number][1] + 1)
            if not entry["rows"]:
                return self._forget(table, entry)
            self._apply("append", table, entry, next_id, checked)
            if sum("keys" in f for f in self._last(table)["folders"]) > SMALL_FOLDERS:
                self.compact(table)

    def delete(self, table: str, keys: Sequence[int] | DataFrame) -> None:
        """Rows with these keys go: a list, or a DataFrame whose column is called as the table's first key. Keys that aren't there don't matter."""
        key = self.unique[table][0]
        kind = StructType([self.schemas[table][key]])
        with self.transaction():
            self._last(table)
            entry: dict = {}
            if not isinstance(keys, DataFrame):
                own = sorted(set(keys))
                if len(own) <= INLINE_KEYS:
                    entry = {"keys": own, "rows": len(own), "range": [own[0], own[-1]] if own else None}
                else:
                    keys = self.spark.createDataFrame([(k,) for k in own], kind)
            if not entry:
                entry["name"] = self._new(table, "deletes")
                path = f"{self.root}/{table}/{entry['name']}"
                keys.select(F.col(key).cast(kind[0].dataType)).where(F.col(key).isNotNull()).distinct().write.parquet(path)
                low, high, n = self.spark.read.schema(kind).parquet(path).agg(F.min(key), F.max(key), F.count("*")).first()
                entry |= {"rows": n, "range": [low, high] if n else None}
            if entry["rows"]:
                self._apply("delete", table, entry)
            if len(self._last(table)["deletes"]) > DELETES:
                self.compact(table)

    def replace(self, table: str, df: DataFrame, bad: Mapping[str, Column] = {}) -> None:
        """Rows in place of those with the same first key, and new ones. The old ones' deletion names the new folder's keys."""
        with self.transaction():
            self._last(table)
            entry = self._described(table, self._save(table, df), bad)
            if not entry["rows"]:
                return self._forget(table, entry)
            key = self.unique[table][0]
            gone = {"rows": entry["rows"], "range": entry["ranges"][key]}
            self._apply("delete", table, gone | ({"keys": sorted(entry["keys"][key])} if "keys" in entry else {"name": entry["name"]}))
            self._apply("append", table, entry, self.next_id(table), False)
            if len(self._last(table)["deletes"]) > DELETES or sum("keys" in f for f in self._last(table)["folders"]) > SMALL_FOLDERS:
                self.compact(table)

    def compact(self, table: str) -> None:
        """Small folders, and those that deletes are about, become one folder without deleted rows; the others stay as they are."""
        with self.transaction():
            last = self._last(table)
            small = [f for f in last["folders"] if "keys" in f]
            old = [f for f in last["folders"] if len(small) > 1 and "keys" in f or any(self._holds(d, f, table) for d in last["deletes"])]
            if old:
                entry = self._described(table, self._save(table, self._rows(table, [(f, [f["name"]]) for f in old])))
                self._apply("swap", table, {f["name"] for f in old}, entry, last["clock"])
