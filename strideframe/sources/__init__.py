"""Clip catalogues, and tables written by clip."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import suffix

#: Fixed value: suffixes of video files.
VIDEO_SUFFIXES = [".mp4", ".mov", ".mkv", ".avi", ".m4v"]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below ``root``; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def clip_catalog(paths: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """Rows whose path has a video suffix, in any case. Null paths go."""
    return paths.where(suffix(F.col("path")).isin(suffixes or VIDEO_SUFFIXES))


def normalize_clips(clips: DataFrame, default_fps: float = 30.0) -> DataFrame:
    """Frame rates that are null or not positive become the default, null counts 0."""
    return clips.withColumns({"fps": F.when(F.col("fps") > 0, F.col("fps")).otherwise(F.lit(default_fps)), "total_frames": F.coalesce("total_frames", F.lit(0))})


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one only in a single local process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-")


def write_by_clip(df: DataFrame, path: str, files: int) -> None:
    """Parquet, all rows of a clip in one file, sorted by clip so that readers skip row groups."""
    df.repartition(files, "clip_id").sortWithinPartitions("clip_id").write.parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """A table of the catalogue in ``buckets`` files dealt by clip, each sorted by clip and frame; returns it as read.

    Jobs over tables of equally many buckets exchange none of them (pass ``dealt=True``), for
    reading keeps the dealing. ``path`` is a folder that all executors share. Rows without a
    clip_id are in one bucket. An empty table has its schema.
    """
    order = [c for c in ("clip_id", "frame") if c in df.columns]
    df.repartition(buckets, "clip_id").write.bucketBy(buckets, "clip_id").sortBy(*order).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
