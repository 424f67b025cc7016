"""Ground contacts of each foot and what they sum to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import given, to_px
from .signals import contact_flag, contact_thresholds, drop_short_runs, interpolate_gaps, moving_average, rising_edges, velocity


def time_axis(df: DataFrame, fps: float | str) -> DataFrame:
    """Adds t_s, seconds from the clip's first frame; ``fps`` is a number or a column with each clip's own.

    Null where the rate isn't positive.
    """
    return df.withColumn("t_s", F.when(given(fps) > 0, F.try_divide(F.col("frame").cast("double"), given(fps).cast("double"))))


def with_any_foot(feet: DataFrame) -> DataFrame:
    """Clips of which some foot has a height; the others give no result at all."""
    known = F.count("y").over(W.partitionBy("clip_id"))
    return feet.withColumn("_known", known).where("_known > 0").drop("_known")


def find_contacts(feet: DataFrame, fps: float | str, window: int = 5, min_len: int = 3) -> DataFrame:
    """From raw foot points to contacts and steps, frame by frame; one dealing by clip serves all.

    ``fps`` is a number or a column of ``feet`` with each clip's own. A clip whose rate isn't
    positive has no speeds, and so no contacts.
    """
    dt = F.when(given(fps) > 0, F.try_divide(F.lit(1.0), given(fps).cast("double")))
    raw = feet.withColumns({"x_raw": F.col("x"), "y_raw": F.col("y")})
    smooth = moving_average(interpolate_gaps(with_any_foot(raw), ["x", "y"]), ["x", "y"], window)
    flagged = contact_flag(contact_thresholds(velocity(smooth, "y", dt)))
    return time_axis(rising_edges(drop_short_runs(flagged, "contact", min_len), "contact"), fps)


def contact_state(frames: DataFrame) -> DataFrame:
    return frames.withColumn("state", F.when(F.col("contact"), "CONTACT").otherwise("SWING"))


def contact_summary(frames: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Steps, seconds, steps a second and mean step interval per clip and foot.

    n_frames is the requested length, n_frames of ``ranges`` (clip_id, n_frames), where that
    is known; else as many frames as there are.
    """
    step_t = F.when(F.col("step"), F.col("t_s"))
    total = F.max("t_s") - F.min("t_s")
    n = F.count_if("step")
    summed = frames.groupBy("clip_id", "foot").agg(
        n.alias("steps"),
        F.count("*").alias("n_frames"),
        F.count_if("contact").alias("contact_frames"),
        total.alias("total_s"),
        F.coalesce(F.when(total > 0, n / total), F.lit(0.0)).alias("frequency"),
        F.when(n >= 2, (F.max(step_t) - F.min(step_t)) / (n - 1)).alias("mean_interval_s"),
    )
    if ranges is None:
        return summed
    asked = ranges.select("clip_id", F.col("n_frames").alias("asked"))
    return summed.join(asked, "clip_id", "left").withColumn("n_frames", F.coalesce("asked", "n_frames").cast("long")).drop("asked")


def foot_trail(frames: DataFrame, width: int | str, height: int | str) -> DataFrame:
    """Smoothed foot points in pixels with contact; ``seen`` counts those drawn so far."""
    points = frames.where("x IS NOT NULL AND y IS NOT NULL")
    upto = W.partitionBy("clip_id", "foot").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    return points.select("clip_id", "foot", "frame", to_px(F.col("x"), given(width), True).alias("px"), to_px(F.col("y"), given(height), True).alias("py"), "contact", F.sum(F.lit(1)).over(upto).alias("seen"))


def normalize_range(ranges: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip_id, start_frame, end_frame, n_frames): clamped to the clip, then put in order.

    A range with a side missing gives no row.
    """
    joined = ranges.join(clips.select("clip_id", "total_frames"), "clip_id").where("start_frame IS NOT NULL AND end_frame IS NOT NULL")
    a, b = F.greatest(F.lit(0), "start_frame"), F.least(F.col("total_frames") - 1, F.col("end_frame"))
    return joined.select("clip_id", F.least(a, b).alias("start_frame"), F.greatest(a, b).alias("end_frame"), (F.abs(b - a) + 1).alias("n_frames"))


def within_range(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    return frames.join(ranges, "clip_id").where(F.col("frame").between(F.col("start_frame"), F.col("end_frame"))).drop("start_frame", "end_frame", "n_frames")
