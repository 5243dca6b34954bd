"""Matches that keep coming: the first of each pair goes into the scene store, pairs that come again go to a list of their own.

Which pairs were there is state, kept by pair, that starts from the store's pairs; so no batch reads the store. A batch
that comes again after a failure adds nothing: the store's manifest says which batch it has from the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import ids
from ..operators.store import SceneStore

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PAYLOAD = "image_id1 long, image_id2 long, matches array<struct<idx1:long,idx2:long>>"
_FOUND = "pair_id long, first string, n_dups long, known boolean"


class FirstOfPair(StatefulProcessor):
    """Of each pair in each batch one row: its first match in ``order`` if the pair is new, and how often it came besides."""

    def __init__(self, order: list[str]) -> None:
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "there boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, n = None, 0
        for frame in rows:  # a pair's rows come in parts: only the first so far is kept
            n += len(frame)
            head = frame.sort_values(self.order, kind="stable", na_position="first").head(1)
            best = head if best is None else pd.concat([best, head]).sort_values(self.order, kind="stable", na_position="first").head(1)
        known = self.seen.exists()
        self.seen.update((True,))
        yield pd.DataFrame({"pair_id": [key[0]], "first": [None if known else best["payload"].iloc[0]], "n_dups": [n - 1], "known": [known]})

    def close(self) -> None:
        pass


def first_of_pairs(stream: DataFrame, store: SceneStore, order: list[str]) -> DataFrame:
    """(pair_id, first, n_dups, known) of the stream (image_id1, image_id2, matches, the columns of ``order``); first: the match as JSON, null
    where the pair was known from earlier batches or the store. Rows without both ids aren't pairs and are left out."""
    rows = stream.where(F.col("image_id1").isNotNull() & F.col("image_id2").isNotNull())
    payload = F.to_json(F.struct(F.col("image_id1").cast("long").alias("image_id1"), F.col("image_id2").cast("long").alias("image_id2"), "matches"), {"ignoreNullFields": "false"})
    rows = rows.select(ids.pair_id("image_id1", "image_id2").alias("pair_id"), payload.alias("payload"), *order)
    there = store.table("matches").select("pair_id").groupBy("pair_id")
    return rows.groupBy("pair_id").transformWithStateInPandas(FirstOfPair(order), _FOUND, "Append", "None", there)


def into(store: SceneStore, name: str, repeats: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of ``first_of_pairs``: what is new goes into the store, once for each number of a batch of the stream ``name``.

    repeats: a folder for (batch, pair_id, n_dups, known), the pairs that came more than once in a batch or were known before; a batch
    that comes again writes its rows anew.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if repeats:
                batch.where("known or n_dups > 0").select("pair_id", "n_dups", "known").write.mode("overwrite").parquet(f"{repeats}/batch={number}")
            with store.transaction(name, number) as new:
                if new:
                    store.add_matches(batch.where("first is not null").select(F.from_json("first", _PAYLOAD).alias("m")).select("m.*"))
        finally:
            batch.unpersist()

    return one


def stream_matches(stream: DataFrame, store: SceneStore, order: list[str], checkpoint: str, repeats: str | None = None, name: str | None = None) -> DataStreamWriter:
    """A writer of ``stream`` into ``store``; call ``start()`` on it. ``name`` is the stream's in the store, by default ``checkpoint``.

    State by pair needs the session's state store to be RocksDB; it is set so where nothing else is.
    """
    conf = stream.sparkSession.conf
    if "RocksDB" not in (conf.get(_PROVIDER, None) or ""):
        conf.set(_PROVIDER, _ROCKS)
    found = first_of_pairs(stream, store, order)
    return found.writeStream.outputMode("append").foreachBatch(into(store, name or checkpoint, repeats)).option("checkpointLocation", checkpoint)
