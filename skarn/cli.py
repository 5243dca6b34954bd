"""``python -m skarn.cli FEATURES IMAGES``: import a folder of features and images into a scene store."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions.cameras import MODELS
from .operators.ingest import import_scene
from .operators.store import SceneStore
from .sources import files, hadoop, hdf5


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("features", help="folder with keypoints and matches, as .h5 files or Parquet tables")
    p.add_argument("images", help="folder of the images")
    p.add_argument("--image-extension", default=".jpg", help="accepted, without effect")
    p.add_argument("--database-path", default="scene.db", help="the store to make")
    p.add_argument("--single-camera", action="store_true")
    p.add_argument("--camera-model", choices=sorted(MODELS), default="simple-radial")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    if a.camera_model == "opencv" and not a.single_camera:
        raise SystemExit("Cannot use opencv camera model without --single-camera")
    spark = spark or SparkSession.builder.getOrCreate()
    if SceneStore(spark, a.database_path).exists():
        raise SystemExit(f"{a.database_path} exists")
    if hadoop.exists(spark, f"{a.features}/keypoints.h5"):
        kps, pairs = hdf5.keypoints(spark, f"{a.features}/keypoints.h5"), hdf5.matches(spark, f"{a.features}/matches.h5")
    else:
        kps, pairs = (spark.read.parquet(f"{a.features}/{t}.parquet") for t in ("keypoints", "matches"))
    import_scene(spark, a.database_path, files.image_headers(spark, a.images), kps, pairs, a.camera_model, a.single_camera, refuse_existing=True)


if __name__ == "__main__":
    main()
