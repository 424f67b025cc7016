"""The three workloads, from detections, landmarks and marks to metrics by clip.

``co_partitioned(spark)`` lets joins on (clip_id, frame) use tables dealt by clip_id alone:
then detections and landmarks are exchanged once each. Results don't depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import named
from ..operators import boxes, contacts, hip, labels, landmarks


def co_partitioned(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


#: Ranges up to which they go to all executors: three numbers each, some tens of MB.
RANGES_SENT = 500_000


def sent(ranges: DataFrame) -> DataFrame:
    """``ranges``, counted, with a broadcast hint if there are no more than RANGES_SENT."""
    return F.broadcast(ranges) if ranges.limit(RANGES_SENT + 1).count() <= RANGES_SENT else ranges


def pruned(rows: DataFrame, ranges: DataFrame, first: str | None, last: str | None, how: str = "inner") -> DataFrame:
    """``rows`` of frames from ``first`` to ``last`` of their clip's range (column names; None leaves a side open).

    Where ``ranges`` are ``sent`` to the rows, others are gone before anything is exchanged; too
    many of them are joined by clip. With ``how`` left, clips without a range keep all rows;
    null sides are open.
    """
    few = ranges.select("clip_id", *[F.col(c).alias(f"_{c}") for c in (first, last) if c])
    joined = rows.join(few, "clip_id", how)
    if first:
        joined = joined.where(F.col(f"_{first}").isNull() | (F.col("frame") >= F.col(f"_{first}"))).drop(f"_{first}")
    if last:
        joined = joined.where(F.col(f"_{last}").isNull() | (F.col("frame") <= F.col(f"_{last}"))).drop(f"_{last}")
    return joined


def _by_clip(df: DataFrame, *columns: str) -> DataFrame:
    """A table of a row a clip, which a job reads several times: kept, so that it is worked out once and its size known."""
    return df.select(*columns).persist()


#: Rows of signals that a task gets, about: the windows over them sort some ten times, about 1.3 KB a row in all.
SIGNALS = 200_000
#: Rows below which a task isn't worth while.
_FEW = 10_000


def parts(spark: SparkSession, rows: int) -> int:
    """Into how many tasks ``rows`` of signals are dealt, so that one's memory doesn't grow with the table.

    Left to itself, Spark deals by bytes as they are compressed, which says little about signals.
    """
    tasks = lambda size: -(-rows // size)
    return max(1, tasks(SIGNALS), min(spark.sparkContext.defaultParallelism, tasks(_FEW)))


def by_clip(signals: DataFrame) -> DataFrame:
    """``signals``, counted, dealt by clip into ``parts``; the windows over them need no further exchange."""
    return signals.repartition(parts(signals.sparkSession, signals.count()), "clip_id")


def _dealt(rows: DataFrame, dealt: bool, n: int | None = None) -> DataFrame:
    return rows if dealt else rows.repartition("clip_id") if n is None else rows.repartition(n, "clip_id")


def _of_clips(clips: DataFrame | None, *values: float | str) -> list[str]:
    names = named(*values)
    if names and clips is None:
        raise ValueError(f"clips must have {', '.join(names)}")
    return names


def ground_contacts(detections: DataFrame, points: DataFrame, ranges: DataFrame, width: int | str, height: int | str, fps: float | str, clips: DataFrame | None = None, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """(frames, summary): contacts by frame and foot, and per clip and foot.

    Landmarks are relative to the raw box, the last known one where a frame has none. Every
    frame of a range counts, whether it has detections, landmarks or neither; ranges lie
    within their clips, and what lies outside them is dropped before it is exchanged. Sizes and
    rate are numbers for all clips, or columns of ``clips``; a clip whose rate isn't positive
    has no contacts, so apply ``sources.normalize_clips`` first for a default. ``dealt``: both
    large tables are dealt by clip already, as bucketed tables are.
    """
    sizes, all_of = _of_clips(clips, width, height), _of_clips(clips, width, height, fps)
    ranges = sent(_by_clip(ranges, "clip_id", "start_frame", "end_frame", "n_frames"))
    if all_of:
        clips = _by_clip(clips, "clip_id", *all_of)
    every = ranges.select("clip_id", F.explode(F.sequence(F.col("start_frame").cast("int"), F.col("end_frame").cast("int"))).alias("frame"))
    # a row a foot for each frame of the ranges
    n = None if dealt else parts(ranges.sparkSession, 2 * (ranges.agg(F.sum("n_frames")).first()[0] or 0))
    kept = _dealt(pruned(detections, ranges, "start_frame", "end_frame"), dealt, n)
    if all_of:
        every = every.join(clips.select("clip_id", *all_of), "clip_id")
    if sizes:
        kept = kept.join(clips.select("clip_id", *sizes), "clip_id")
    found = boxes.detect_with_fallback(kept, width, height, dealt=True).select("clip_id", "frame", "box")
    carried = boxes.carry_forward_box(every.join(found, ["clip_id", "frame"], "left"))
    needed = points.where(F.col("lm_id").isin(landmarks.L_FOOT, landmarks.R_FOOT))
    needed = _dealt(pruned(needed, ranges, "start_frame", "end_frame"), dealt, n)
    # one join: every frame is there, with its landmarks where it has any
    placed = landmarks.gate_visibility(landmarks.roi_to_frame(needed, carried, width, height, every=True))
    frames = contacts.find_contacts(landmarks.foot_series(placed, keep=tuple(named(fps))), fps)
    return frames, contacts.contact_summary(frames, ranges)


def approach(detections: DataFrame, points: DataFrame, marks: DataFrame, clips: DataFrame, width: int | str, height: int | str, dealt: bool = False) -> DataFrame:
    """One row a clip: hip droop over the run-up, and stride. Boxes grow by a margin and aren't carried.

    Sizes are numbers for all clips, or columns of ``clips``; frame rates are those of ``clips``.
    Landmarks after a clip's last step are dropped before they are exchanged (detections aren't:
    the window is counted in frames that have any). ``dealt`` as in ``ground_contacts``.
    """
    sizes = _of_clips(clips, width, height)
    clips = _by_clip(clips, "clip_id", "fps", "total_frames", *sizes)
    steps = _by_clip(labels.step_marks_reduce(marks), "clip_id", "steps", "first_step", "last_step")
    kept = _dealt(detections, dealt)
    if sizes:
        kept = kept.join(clips.select("clip_id", *sizes), "clip_id")
    found = boxes.detect_with_fallback(kept, width, height, dealt=True)
    rois = boxes.expand_roi(found, width, height)
    needed = points.where(F.col("lm_id").isin(landmarks.NOSE, landmarks.L_HIP, landmarks.R_HIP, landmarks.L_ANKLE, landmarks.R_ANKLE))
    needed = _dealt(pruned(needed, sent(steps), None, "last_step", "left"), dealt)
    placed = landmarks.roi_to_frame(needed, rois.select("clip_id", "frame", *sizes, F.col("roi").alias("box")), width, height, every=True)
    series = landmarks.hip_series(placed)
    return labels.approach_summary(clips, hip.hip_droop(series, steps, clips), labels.stride_metrics(steps, clips), steps)
