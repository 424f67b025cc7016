"""What people marked: steps, ranges, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def step_marks_reduce(marks: DataFrame) -> DataFrame:
    """(clip_id, steps, first_step, last_step) of every session that wasn't aborted.

    What follows the first 'e', an abort too, doesn't count. steps are distinct and sorted;
    last_step is the one pressed last, not the greatest. Without steps it is the frame of 'e'.
    """
    end = marks.groupBy("clip_id").agg(F.min(F.when(F.col("action") == "e", F.col("seq"))).alias("_end"), F.min(F.when(F.col("action") == "abort", F.col("seq"))).alias("_abort"))
    kept = marks.join(end, "clip_id").where("(_abort IS NULL OR _abort > _end) AND (_end IS NULL OR seq <= _end)")
    pressed = F.when(F.col("action") == "s", F.col("frame"))
    out = kept.groupBy("clip_id").agg(F.sort_array(F.collect_set(pressed)).alias("steps"), F.min(pressed).alias("first_step"), F.max_by("frame", F.when(F.col("action") == "s", F.col("seq"))).alias("_last"), F.max(F.when(F.col("action") == "e", F.col("frame"))).alias("_e"))
    return out.select("clip_id", "steps", "first_step", F.coalesce("_last", "_e").alias("last_step"))


def range_marks_reduce(marks: DataFrame) -> DataFrame:
    """(clip_id, start_frame, end_frame): the last of each before the session closes, in order.

    A cancel, or a confirm once both sides are set, closes; a confirm with a side missing is
    ignored. A cancelled session, or one with a side missing, has nulls.
    """
    upto = W.partitionBy("clip_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    side = lambda a: F.last(F.when(F.col("action") == a, F.col("frame")), ignorenulls=True).over(upto)
    states = marks.withColumns({"_s": side("start"), "_e": side("end")})
    closes = (F.col("action") == "cancel") | ((F.col("action") == "confirm") & F.col("_s").isNotNull() & F.col("_e").isNotNull())
    closed = states.groupBy("clip_id").agg(F.min_by(F.struct("action", "_s", "_e"), F.when(closes, F.col("seq"))).alias("c"))
    done = F.col("c.action") == "confirm"
    return closed.select("clip_id", F.when(done, F.least("c._s", "c._e")).alias("start_frame"), F.when(done, F.greatest("c._s", "c._e")).alias("end_frame"))


def stride_metrics(steps: DataFrame, clips: DataFrame) -> DataFrame:
    """Mean positive interval of consecutive steps, steps a second and a minute.

    Null for fewer than two steps or a rate that isn't positive.
    """
    each = steps.select("clip_id", F.explode_outer("steps").alias("frame")).join(clips.select("clip_id", "fps"), "clip_id")
    t = F.when(F.col("fps") > 0, F.try_divide(F.col("frame").cast("double"), F.col("fps")))
    gaps = each.withColumn("t", t).withColumn("gap", F.col("t") - F.lag("t").over(W.partitionBy("clip_id").orderBy("frame")))
    mean = F.avg(F.when(F.col("gap") > 0, F.col("gap")))
    out = gaps.groupBy("clip_id").agg(F.count("frame").alias("n_steps"), mean.alias("mean_interval_s"))
    rate = F.try_divide(F.lit(1.0), F.col("mean_interval_s"))
    return out.select("clip_id", "n_steps", "mean_interval_s", rate.alias("stride_rate"), (F.lit(60.0) * rate).alias("cadence"))


def step_highlight(steps: DataFrame, clips: DataFrame) -> DataFrame:
    """Distinct frames around each step: a thirtieth of a second to either side, one frame at least.

    The interval becomes rows, so that frames join by equality.
    """
    each = steps.select("clip_id", F.explode("steps").alias("step")).join(clips.select("clip_id", "fps", "total_frames"), "clip_id")
    half = F.when(F.col("fps") > 0, F.greatest(F.lit(1), F.rint(F.col("fps") / F.lit(30.0)).cast("int"))).otherwise(F.lit(1))
    bounds = each.withColumns({"_a": F.greatest(F.lit(0), F.col("step") - half), "_b": F.least(F.col("total_frames") - 1, F.col("step") + half)}).where("_a <= _b")
    return bounds.select("clip_id", F.explode(F.sequence("_a", "_b")).alias("frame")).distinct()


def phase_flags(frames: DataFrame, steps: DataFrame) -> DataFrame:
    """Adds before_first, in_approach and jump; all false where no steps are known."""
    joined = frames.join(steps.select("clip_id", "first_step", "last_step"), "clip_id", "left")
    f, flag = F.col("frame"), lambda c: F.coalesce(c, F.lit(False))
    return joined.withColumns({"before_first": flag(f < F.col("first_step")), "jump": flag(f > F.col("last_step")), "in_approach": flag((f >= F.coalesce("first_step", F.lit(0))) & (f <= F.col("last_step")))}).drop("first_step", "last_step")


def mark_frames(frames: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
    """Adds a flag for the frames of ``chosen`` (clip_id, frame)."""
    flag = chosen.select("clip_id", "frame").distinct().withColumn(name, F.lit(True))
    return frames.join(flag, ["clip_id", "frame"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def approach_summary(clips: DataFrame, hip: DataFrame, stride: DataFrame, steps: DataFrame) -> DataFrame:
    """One row a clip: analysis window in frames and seconds, stride and hip metrics.

    A clip without frames has n_valid 0.
    """
    joined = clips.join(steps.select("clip_id", "first_step", "last_step"), "clip_id", "left").join(stride, "clip_id", "left").join(hip.drop("worst_frames"), "clip_id", "left")
    some = F.col("last_step").isNotNull()
    start = F.when(some, F.coalesce("first_step", F.lit(0))).otherwise(F.lit(0))
    end = F.when(some, F.col("last_step")).otherwise(F.col("total_frames") - 1)
    seconds = lambda c: F.when(F.col("fps") > 0, F.try_divide(c.cast("double"), F.col("fps")))
    return joined.select("clip_id", start.alias("start_frame"), end.alias("end_frame"), seconds(start).alias("t_start"), seconds(end).alias("t_end"), "n_steps", "stride_rate", "cadence", "hip_droop_pct", "hip_droop_trend_pct", F.coalesce("n_valid", F.lit(0)).alias("n_valid"))
