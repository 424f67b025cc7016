"""Hip droop over an approach: baseline of the first valid frames, late worst frames, trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import given, to_px
from .signals import iqr_outlier_flag


def _clip() -> WindowSpec:
    return W.partitionBy("clip_id")


def _frames() -> WindowSpec:
    return W.partitionBy("clip_id").orderBy("frame")


def analysis_window(series: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Adds start_idx and end_idx (exclusive), from the first step to just after the last one, and
    ended: whether a last step is known.

    ``bounds`` (clip_id, first_step, last_step) is one row a clip; without it, or where it is
    null, the whole clip is meant.
    """
    if bounds is not None:
        series = series.join(bounds.select("clip_id", "first_step", "last_step"), "clip_id", "left")
    else:
        series = series.withColumns({"first_step": F.lit(None).cast("int"), "last_step": F.lit(None).cast("int")})
    return series.withColumns(window_of(F.count("*").over(_clip()).cast("int"))).drop("first_step", "last_step")


def window_of(n: Column) -> dict[str, Column]:
    """start_idx, end_idx and ended of a clip of ``n`` frames, from first_step and last_step."""
    start = F.greatest(F.lit(0), F.least(F.coalesce("first_step", F.lit(0)), n - 1))
    end = F.least(F.coalesce(F.col("last_step") + 1, n), n)
    return {"start_idx": start, "end_idx": end, "ended": F.col("last_step").isNotNull()}


def counts_in_window() -> Column:
    """Whether a frame is in the analysis window and has a usable pose."""
    return F.coalesce((F.col("frame") >= F.col("start_idx")) & (F.col("frame") < F.col("end_idx")) & (F.col("body_h") > 1e-4) & F.col("hip_y").isNotNull(), F.lit(False))


def baseline_size(n: Column) -> Column:
    """How many first frames of ``n`` valid ones make the baseline."""
    return F.least(n, F.greatest(F.lit(3), (F.lit(0.2) * n).cast("int")))


def worst_size(n_late: Column, share: float = 0.05) -> Column:
    """How many of the ``n_late`` frames of the later half count as worst."""
    return F.least(n_late, F.greatest(F.lit(1), F.rint(F.lit(share) * n_late)))


def valid_pose_frames(series: DataFrame) -> DataFrame:
    return series.where("hip_y IS NOT NULL AND body_h IS NOT NULL AND body_h > 1e-4")


def in_window(series: DataFrame) -> DataFrame:
    return series.where("frame >= start_idx AND frame < end_idx")


def ranked(frames: DataFrame, valid: Column | None = None) -> DataFrame:
    """Adds rank (from 0), n_valid, and k: how many first frames make the baseline.

    All frames count, or those that are ``valid``; others keep their rows.
    """
    one = F.lit(1) if valid is None else valid.cast("int")
    n = F.sum(one).over(_clip())
    upto = _frames().rowsBetween(W.unboundedPreceding, 0)
    return frames.withColumns({"rank": (F.sum(one).over(upto) - 1).cast("int"), "n_valid": n, "k": baseline_size(n)})


def hip_baseline(frames: DataFrame, valid: Column | None = None) -> DataFrame:
    """Adds base_hip and base_height: means over the first k frames within both Tukey fences.

    Frames that miss either fence don't count; if all do, all k count. Of ``frames`` those
    that are ``valid`` count, all by default.
    """
    some = F.lit(True) if valid is None else valid
    rows = ranked(frames, valid).withColumn("early", some & (F.col("rank") < F.col("k")))
    rows = rows.withColumns({f"_{c}": F.when(F.col("early"), F.col(c)) for c in ("hip_y", "body_h")})
    rows = iqr_outlier_flag(rows, ["_hip_y", "_body_h"], ["clip_id"]).drop("_hip_y", "_body_h")
    good = F.col("early") & F.col("_hip_y_in") & F.col("_body_h_in")
    mean = lambda c: F.coalesce(F.avg(F.when(good, F.col(c))).over(_clip()), F.avg(F.when(F.col("early"), F.col(c))).over(_clip()))
    return rows.withColumns({"base_hip": mean("hip_y"), "base_height": mean("body_h")}).drop("_hip_y_in", "_body_h_in")


def droop_series(based: DataFrame) -> DataFrame:
    """Adds droop, in per cent of body height; positive is lower. Null for fewer than 3 valid frames."""
    droop = (F.col("hip_y") - F.col("base_hip")) / F.col("base_height") * F.lit(100.0)
    return based.withColumn("droop", F.when(F.col("n_valid") >= 3, droop))


def worst_frames(drooped: DataFrame, share: float = 0.05) -> DataFrame:
    """Of the later half, the ``share`` of frames that droop most (one at least); ties by later frame."""
    late = drooped.where("n_valid >= 3 AND rank >= floor(n_valid / 2)").withColumn("n_late", F.count("*").over(_clip()))
    order = F.row_number().over(_clip().orderBy(F.desc("droop"), F.desc("frame")))
    return late.withColumn("place", order).where(F.col("place") <= worst_size(F.col("n_late"), share))


def hip_droop(series: DataFrame, bounds: DataFrame | None = None, clips: DataFrame | None = None) -> DataFrame:
    """One row for every clip of ``series``, and of ``clips`` if given: droop, its trend, valid frames, worst frames, bounds.

    The droop is the mean of the worst frames, the trend the later half's mean less that of
    the first k frames. Fewer than 3 valid frames leave both null. A clip without frames has
    n_valid, start_idx and end_idx 0.
    """
    windowed = analysis_window(series, bounds).withColumn("valid", counts_in_window())
    # frames that don't count keep their rows, so that one aggregation gives bounds and metrics
    drooped = droop_series(hip_baseline(windowed, F.col("valid")))
    late = F.col("valid") & (F.col("rank") >= F.floor(F.col("n_valid") / 2))
    order = F.row_number().over(W.partitionBy("clip_id", "late").orderBy(F.desc("droop"), F.desc("frame")))
    n_late = F.col("n_valid") - F.floor(F.col("n_valid") / 2)
    marked = drooped.withColumn("late", late).withColumn("worst", F.col("late") & (order <= worst_size(n_late)) & (F.col("n_valid") >= 3))
    out = marked.groupBy("clip_id").agg(
        F.avg(F.when(F.col("worst"), F.col("droop"))).alias("hip_droop_pct"),
        (F.avg(F.when(F.col("late"), F.col("droop"))) - F.avg(F.when(F.col("early"), F.col("droop")))).alias("hip_droop_trend_pct"),
        F.count_if("valid").cast("int").alias("n_valid"),
        F.sort_array(F.collect_list(F.when(F.col("worst"), F.col("frame")))).alias("worst_frames"),
        F.max("start_idx").alias("start_idx"),
        F.max("end_idx").alias("end_idx"),
    )
    if clips is not None:
        out = clips.select("clip_id").distinct().join(out, "clip_id", "left").fillna(0, ["n_valid", "start_idx", "end_idx"])
    return out.select("clip_id", "hip_droop_pct", "hip_droop_trend_pct", "n_valid", F.coalesce("worst_frames", F.array().cast("array<int>")).alias("worst_frames"), "start_idx", "end_idx")


def hip_trail(points: DataFrame, worst: DataFrame, width: int | str, height: int | str) -> DataFrame:
    """Hip points (x, y) in the analysis window as pixels, whether worst, and how many are drawn so far.

    Only clips whose last step is known have a trail.
    """
    upto = _frames().rowsBetween(W.unboundedPreceding, 0)
    shown = in_window(points).where("ended AND x IS NOT NULL AND y IS NOT NULL")
    flagged = shown.join(worst.select("clip_id", "frame", F.lit(True).alias("w")), ["clip_id", "frame"], "left")
    return flagged.select("clip_id", "frame", to_px(F.col("x"), given(width)).alias("px"), to_px(F.col("y"), given(height)).alias("py"), F.coalesce("w", F.lit(False)).alias("worst"), F.sum(F.lit(1)).over(upto).alias("seen"))
