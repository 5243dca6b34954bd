"""Scene store: six tables in versions, with the rules of each table's rows and its reads by key.

Parquet enforces neither keys nor ranges, so each write checks them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..sources.schema import KEYPOINT_COLUMNS, MAX_ID, NUMBERED, TABLES, UNIQUE
from .tabular import with_ids
from .versions import ConstraintError, VersionedTables, none_of

__all__ = ["ConstraintError", "SceneStore", "none_of", "valid_layout"]
IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def valid_layout(cols: str) -> Column:
    """Whether keypoints may have so many columns."""
    return F.col(cols).isin(*KEYPOINT_COLUMNS)


class SceneStore(VersionedTables):
    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__(spark, root, TABLES, UNIQUE)

    def register_views(self) -> None:
        """The tables as temporary views, for any SQL."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)

    def sql(self, text: str) -> DataFrame:
        self.register_views()
        return self.spark.sql(text)

    # --- writes ----------------------------------------------------------------------------------

    def _append(self, table: str, df: DataFrame, constants: Mapping[str, Column] = {}) -> None:
        rules = {"image_id out of range": ~ids.valid_image_id("image_id")} if table == "images" else {}
        self.append(table, df, NUMBERED.get(table), rules, constants=constants)

    def _numbered(self, table: str, df: DataFrame, order: Sequence[str]) -> DataFrame:
        """Rows without a number get the next ones, in ``order``; given numbers stay and are never given again."""
        column = NUMBERED[table]
        first = self.next_id(table)
        if column not in df.columns:
            return with_ids(df, column, [F.col(c) for c in order], first)
        given, new = df.where(F.col(column).isNotNull()), df.where(F.col(column).isNull()).drop(column)
        first = max(first, (given.agg(F.max(column)).first()[0] or 0) + 1)
        return given.unionByName(with_ids(new, column, [F.col(c) for c in order], first))

    def add_cameras(self, df: DataFrame, order: Sequence[str] = ("model", "width", "height", "params")) -> None:
        """(model, width, height, params, [prior_focal_length], [camera_id])."""
        if "prior_focal_length" not in df.columns:
            df = df.withColumn("prior_focal_length", F.lit(0))
        self._append("cameras", self._numbered("cameras", df.withColumn("prior_focal_length", F.col("prior_focal_length").cast("int")), order))

    def add_images(self, df: DataFrame, order: Sequence[str] = ("name",)) -> None:
        """(name, camera_id, [priors], [image_id]); priors that are missing are zeros."""
        priors = {f.name: F.lit(0.0) for f in TABLES["images"] if f.name.startswith("prior_") and f.name not in df.columns}
        self._append("images", self._numbered("images", df, order), priors)

    def add_camera(self, model: int, width: int, height: int, params: Sequence[float], prior_focal_length: bool = False, camera_id: int | None = None) -> int:
        number = self.next_id("cameras") if camera_id is None else camera_id
        row = [(number, model, width, height, [float(p) for p in params], int(prior_focal_length))]
        self.add_cameras(self.spark.createDataFrame(row, TABLES["cameras"]))
        return number

    def add_image(self, name: str, camera_id: int, prior_q: Sequence[float] = (0.0,) * 4, prior_t: Sequence[float] = (0.0,) * 3, image_id: int | None = None) -> int:
        number = self.next_id("images") if image_id is None else image_id
        self.add_images(self.spark.createDataFrame([(number, name, camera_id, *map(float, prior_q), *map(float, prior_t))], TABLES["images"]))
        return number

    def _matrices(self, df: DataFrame, cast: Column) -> DataFrame:
        """(image_id, data) with rows and cols; rows of unequal length raise."""
        df = df.select("image_id", F.coalesce("data", F.array().cast("array<array<double>>")).alias("data"))
        cols = F.coalesce(F.size(F.get("data", F.lit(0))), F.lit(2))
        df = df.withColumns({"rows": F.size("data"), "cols": cols})
        none_of(df, F.exists("data", lambda r: F.size(r) != F.col("cols")), "rows of unequal length")
        return df.withColumn("data", cast)

    def _keypoints(self, df: DataFrame) -> DataFrame:
        df = self._matrices(df, F.col("data").cast("array<array<float>>"))
        none_of(df, ~valid_layout("cols"), "keypoints: columns must be 2, 4 or 6")
        return df

    def _descriptors(self, df: DataFrame) -> DataFrame:
        return self._matrices(df, F.transform("data", lambda r: F.transform(r, ids.uint8)))

    def add_keypoints(self, df: DataFrame) -> None:
        """(image_id, data array<array>): 2, 4 or 6 columns, kept as 32-bit floats."""
        self._append("keypoints", self._keypoints(df))

    def add_descriptors(self, df: DataFrame) -> None:
        """(image_id, data array<array>), kept modulo 256."""
        self._append("descriptors", self._descriptors(df))

    def replace_keypoints(self, df: DataFrame) -> None:
        self.replace("keypoints", self._keypoints(df))

    def replace_descriptors(self, df: DataFrame) -> None:
        self.replace("descriptors", self._descriptors(df))

    def delete_keypoints(self, image_ids: int | Sequence[int] | DataFrame) -> None:
        """Rows of these images go; ids that have none don't matter."""
        self.delete("keypoints", [image_ids] if isinstance(image_ids, int) else image_ids)

    def delete_descriptors(self, image_ids: int | Sequence[int] | DataFrame) -> None:
        self.delete("descriptors", [image_ids] if isinstance(image_ids, int) else image_ids)

    def _pairs(self, df: DataFrame) -> DataFrame:
        indices = F.transform(ids.canonical("image_id1", "image_id2", "matches"), lambda m: F.struct(ids.uint32(m["idx1"]).alias("idx1"), ids.uint32(m["idx2"]).alias("idx2")))
        none_of(df, ~(ids.valid_image_id("image_id1") & ids.valid_image_id("image_id2")), "image id out of range")
        return df.withColumns({"pair_id": ids.pair_id("image_id1", "image_id2"), "matches": indices, "image_id1": F.least("image_id1", "image_id2"), "image_id2": F.greatest("image_id1", "image_id2")})

    def add_matches(self, df: DataFrame) -> None:
        """(image_id1, image_id2, matches array<struct<idx1, idx2>>): kept in the order (smaller, greater id)."""
        self._append("matches", self._pairs(df))

    def add_two_view_geometries(self, df: DataFrame) -> None:
        """As matches, with config (2 by default) and F, E, H (9 by rows, identities by default), which are kept as given
        where the pair is turned round."""
        missing = {m: F.array(*map(F.lit, IDENTITY)) for m in "FEH" if m not in df.columns} | ({} if "config" in df.columns else {"config": F.lit(2)})
        for m in "FEH":
            if m not in missing:
                none_of(df, F.size(m) != 9, "two_view_geometries: matrices have 9 values")
        self._append("two_view_geometries", self._pairs(df), missing)

    # --- reads -----------------------------------------------------------------------------------

    def rows_of(self, table: str, image_ids: int | Sequence[int] | DataFrame) -> DataFrame:
        """Rows of these images: only files that can hold one of a few ids are opened, a DataFrame (image_id) is joined."""
        if isinstance(image_ids, DataFrame):
            return self.table(table).join(image_ids.select("image_id"), "image_id", "left_semi")
        return self.rows_by_key(table, [image_ids] if isinstance(image_ids, int) else image_ids)

    def matches_of(self, pairs: DataFrame) -> DataFrame:
        """Rows of the pairs (image_id1, image_id2) in whatever order they are given, always as (smaller, greater id)."""
        asked = pairs.select(ids.pair_id("image_id1", "image_id2").alias("pair_id")).distinct()
        return self.table("matches").join(asked, "pair_id", "left_semi")

    def image_ids(self) -> DataFrame:
        return self.table("images").select("image_id")

    def select_keypoints(self, image_id: int) -> list[list[float]] | None:
        row = self.rows_of("keypoints", image_id).first()
        return row and row["data"]

    def select_descriptors(self, image_id: int) -> list[list[int]] | None:
        row = self.rows_of("descriptors", image_id).first()
        return row and row["data"]

    def select_matches(self, image_id1: int, image_id2: int) -> list[Row] | None:
        """Matches of a pair in whatever order it is given, always as (smaller, greater id); None without any."""
        low, high = sorted((image_id1, image_id2))
        row = self.rows_by_key("matches", [low * MAX_ID + high]).first()
        return row and row["matches"]

    def select_image(self, image_id: int) -> dict:
        row = self.rows_of("images", image_id).first()
        if row is None:
            raise KeyError(image_id)
        return row.asDict()

    def fetch_images(self, eager: bool = False, as_dict: bool = True) -> list | Iterator:
        df = self.table("images")
        rows = (r.asDict() if as_dict else tuple(r) for r in (df.collect() if eager else df.toLocalIterator()))
        return list(rows) if eager else rows

    def select_image_ids(self, eager: bool = False) -> list[int] | Iterator[int]:
        df = self.image_ids()
        found = (r[0] for r in (df.collect() if eager else df.toLocalIterator()))
        return list(found) if eager else found

    def validate_refs(self) -> None:
        """Raise where a row names an image or camera that isn't there; writes don't ask."""
        images = self.table("images")
        none_of(images.join(self.table("cameras"), "camera_id", "left_anti"), F.lit(True), "images: no such camera")
        for t in ("keypoints", "descriptors"):
            none_of(self.table(t).select("image_id").join(images, "image_id", "left_anti"), F.lit(True), f"{t}: no such image")
