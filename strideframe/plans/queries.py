"""One query for each operator, over tables derived from the supplied ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions, sources
from ..operators import bend, boxes, chunks, contacts, hip, labels, landmarks, sampling, signals
from ..sources import clip_catalog as keep_videos
from ..sources import normalize_clips as with_defaults
from ..sources.fixtures import FPS, HEIGHT, WIDTH, derived
from . import jobs

FOOT = ["clip_id", "foot", "frame"]


def _r(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


def _box(df: DataFrame, name: str = "box") -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], *[F.col(f"{name}.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


def _clips(s: SparkSession, d: str) -> DataFrame:
    return derived(s, d, "clips")


def clip_catalog(s: SparkSession, d: str) -> DataFrame:
    return keep_videos(_clips(s, d)).select("clip_id", "path")


def normalize_clips(s: SparkSession, d: str) -> DataFrame:
    return with_defaults(_clips(s, d)).select("clip_id", "fps", "total_frames")


def _plan(s: SparkSession, d: str) -> DataFrame:
    return sampling.frame_sample_plan(with_defaults(keep_videos(_clips(s, d))), fps=2.0, start=0.5, end=60.0)


def frame_sample_plan(s: SparkSession, d: str) -> DataFrame:
    return _plan(s, d).select("clip_id", "frame", "stride")


def sample_output_path(s: SparkSession, d: str) -> DataFrame:
    return sampling.sample_output_path(_plan(s, d), "out").select("clip_id", "frame", "output")


def _steps(s: SparkSession, d: str) -> DataFrame:
    return labels.step_marks_reduce(derived(s, d, "step_marks"))


def _ranges(s: SparkSession, d: str) -> DataFrame:
    return labels.range_marks_reduce(derived(s, d, "range_marks"))


def normalize_range(s: SparkSession, d: str) -> DataFrame:
    return contacts.normalize_range(_ranges(s, d), derived(s, d, "user_clips"))


def _dets(s: SparkSession, d: str) -> DataFrame:
    return derived(s, d, "detections")


def largest_person_box(s: SparkSession, d: str) -> DataFrame:
    return _box(boxes.largest_person_box(_dets(s, d), WIDTH, HEIGHT))


def _found(s: SparkSession, d: str) -> DataFrame:
    return boxes.detect_with_fallback(_dets(s, d), WIDTH, HEIGHT)


def detect_with_fallback(s: SparkSession, d: str) -> DataFrame:
    return _box(_found(s, d))


def expand_roi(s: SparkSession, d: str) -> DataFrame:
    return _box(boxes.expand_roi(_found(s, d), WIDTH, HEIGHT).drop("box"), "roi")


def carry_forward_box(s: SparkSession, d: str) -> DataFrame:
    return _box(boxes.carry_forward_box(_found(s, d)))


def _lms(s: SparkSession, d: str) -> DataFrame:
    return derived(s, d, "landmarks").drop("vec_id")


def _rois(s: SparkSession, d: str, name: str = "box") -> DataFrame:
    return derived(s, d, "rois").select("clip_id", "frame", F.when(F.col("has"), F.struct("x1", "y1", "x2", "y2")).alias(name))


def _placed(s: SparkSession, d: str) -> DataFrame:
    return landmarks.roi_to_frame(_lms(s, d), _rois(s, d), WIDTH, HEIGHT)


def roi_to_frame(s: SparkSession, d: str) -> DataFrame:
    return _placed(s, d).select("clip_id", "frame", "lm_id", *_r("x", "y"))


def gate_visibility(s: SparkSession, d: str) -> DataFrame:
    return landmarks.gate_visibility(_lms(s, d)).select("clip_id", "frame", "lm_id", *_r("x", "y"))


def _px(s: SparkSession, d: str) -> DataFrame:
    return landmarks.norm_to_px(_lms(s, d), WIDTH, HEIGHT)


def norm_to_px(s: SparkSession, d: str) -> DataFrame:
    clamped = landmarks.norm_to_px(landmarks.gate_visibility(_lms(s, d)), WIDTH, HEIGHT, clamp=True).select("clip_id", "frame", "lm_id", F.col("px").alias("cx"), F.col("py").alias("cy"))
    return _px(s, d).select("clip_id", "frame", "lm_id", "px", "py").join(clamped, ["clip_id", "frame", "lm_id"])


def hip_series(s: SparkSession, d: str) -> DataFrame:
    return landmarks.hip_series(_placed(s, d), _rois(s, d)).select("clip_id", "frame", *_r("hip_y", "body_h"))


def foot_series(s: SparkSession, d: str) -> DataFrame:
    return landmarks.foot_series(landmarks.gate_visibility(_placed(s, d))).select(*FOOT, *_r("x", "y"))


def skeleton_qc(s: SparkSession, d: str) -> DataFrame:
    return landmarks.skeleton_qc(_placed(s, d), _rois(s, d, "roi"), WIDTH, HEIGHT).withColumn("outside", F.round("outside", 6))


def drawable_segments(s: SparkSession, d: str) -> DataFrame:
    return landmarks.drawable_segments(_px(s, d), [(i, i + 1) for i in range(32)], WIDTH, HEIGHT)


def leg_segments(s: SparkSession, d: str) -> DataFrame:
    gated = landmarks.gate_visibility(_lms(s, d))
    return landmarks.leg_segments(landmarks.joint_points(landmarks.norm_to_px(gated, WIDTH, HEIGHT, clamp=True)))


def visible_joints(s: SparkSession, d: str) -> DataFrame:
    return landmarks.visible_joints(_px(s, d), WIDTH, HEIGHT).select("clip_id", "frame", "lm_id", "px", "py")


def _gait(s: SparkSession, d: str) -> DataFrame:
    return jobs.by_clip(derived(s, d, "gait"))


def _filled(s: SparkSession, d: str) -> DataFrame:
    return signals.interpolate_gaps(_gait(s, d), ["x", "y"])


def interpolate_gaps(s: SparkSession, d: str) -> DataFrame:
    return _filled(s, d).select(*FOOT, *_r("x", "y"))


def _smooth(s: SparkSession, d: str) -> DataFrame:
    return signals.moving_average(_filled(s, d), ["x", "y"])


def moving_average(s: SparkSession, d: str) -> DataFrame:
    return _smooth(s, d).select(*FOOT, *_r("x", "y"))


def _moving(s: SparkSession, d: str) -> DataFrame:
    return signals.velocity(_smooth(s, d), "y", 1.0 / FPS)


def velocity(s: SparkSession, d: str) -> DataFrame:
    return _moving(s, d).select(*FOOT, *_r("v"))


def contact_thresholds(s: SparkSession, d: str) -> DataFrame:
    return signals.contact_thresholds(_moving(s, d)).groupBy("clip_id", "foot").agg(F.round(F.max("y_thr"), 6).alias("y_thr"), F.round(F.max("v_thr"), 6).alias("v_thr"))


def _flagged(s: SparkSession, d: str) -> DataFrame:
    return signals.contact_flag(signals.contact_thresholds(_moving(s, d)))


def contact_flag(s: SparkSession, d: str) -> DataFrame:
    return _flagged(s, d).select(*FOOT, "contact")


def drop_short_runs(s: SparkSession, d: str) -> DataFrame:
    return signals.drop_short_runs(_flagged(s, d), "contact").select(*FOOT, "contact")


def _contacts(s: SparkSession, d: str) -> DataFrame:
    return contacts.find_contacts(_gait(s, d), FPS)


def rising_edges(s: SparkSession, d: str) -> DataFrame:
    return _contacts(s, d).where("step").select(*FOOT, *_r("t_s"))


def contact_state(s: SparkSession, d: str) -> DataFrame:
    return contacts.contact_state(_contacts(s, d)).groupBy("clip_id", "foot", "state").agg(F.count("*").alias("frames"))


def contact_summary(s: SparkSession, d: str) -> DataFrame:
    return contacts.contact_summary(_contacts(s, d)).select("clip_id", "foot", "steps", "n_frames", "contact_frames", *_r("total_s", "frequency", "mean_interval_s"))


def foot_trail(s: SparkSession, d: str) -> DataFrame:
    return contacts.foot_trail(_contacts(s, d), WIDTH, HEIGHT)


def _hip(s: SparkSession, d: str) -> DataFrame:
    return derived(s, d, "hip")


def _bounds(df: DataFrame) -> DataFrame:
    """Made-up first and last steps, from the clip's id."""
    ids = df.select("clip_id").distinct()
    return ids.select("clip_id", (F.col("clip_id") % 7 * 3).cast("int").alias("first_step"), F.when(F.col("clip_id") % 5 != 0, (F.col("clip_id") % 11 * 9 + 30).cast("int")).alias("last_step"))


def _windowed(s: SparkSession, d: str, name: str = "hip") -> DataFrame:
    series = derived(s, d, name)
    return hip.analysis_window(series, _bounds(series))


def analysis_window(s: SparkSession, d: str) -> DataFrame:
    return hip.in_window(_windowed(s, d, "hip_short")).select("clip_id", "frame", "start_idx", "end_idx")


def valid_pose_frames(s: SparkSession, d: str) -> DataFrame:
    return hip.valid_pose_frames(_hip(s, d)).select("clip_id", "frame")


def _valid(s: SparkSession, d: str, name: str = "hip") -> DataFrame:
    return hip.valid_pose_frames(hip.in_window(hip.analysis_window(derived(s, d, name))))


def iqr_outlier_flag(s: SparkSession, d: str) -> DataFrame:
    return signals.iqr_outlier_flag(_valid(s, d, "hip_short"), "hip_y", ["clip_id"]).select("clip_id", "frame", "hip_y_in")


def hip_baseline(s: SparkSession, d: str) -> DataFrame:
    based = hip.hip_baseline(_valid(s, d, "hip_short"))
    return based.groupBy("clip_id").agg(F.round(F.max("base_hip"), 6).alias("base_hip"), F.round(F.max("base_height"), 6).alias("base_height"), F.max("k").alias("k"), F.max("n_valid").alias("n_valid"))


def _drooped(s: SparkSession, d: str) -> DataFrame:
    return hip.droop_series(hip.hip_baseline(_valid(s, d)))


def droop_series(s: SparkSession, d: str) -> DataFrame:
    return _drooped(s, d).select("clip_id", "frame", "rank", *_r("droop"))


def worst_frames(s: SparkSession, d: str) -> DataFrame:
    return hip.worst_frames(_drooped(s, d)).select("clip_id", "frame", "place", *_r("droop"))


def hip_droop(s: SparkSession, d: str) -> DataFrame:
    series = derived(s, d, "hip_short")
    out = hip.hip_droop(series, _bounds(series))
    return out.select("clip_id", *_r("hip_droop_pct", "hip_droop_trend_pct"), "n_valid", F.array_join("worst_frames", ",").alias("worst_frames"), "start_idx", "end_idx")


def hip_trail(s: SparkSession, d: str) -> DataFrame:
    points = _windowed(s, d).withColumns({"x": F.col("body_h") * F.lit(1.5), "y": F.col("hip_y")})
    return hip.hip_trail(points, hip.worst_frames(_drooped(s, d)), WIDTH, HEIGHT)


def step_marks_reduce(s: SparkSession, d: str) -> DataFrame:
    return _steps(s, d).withColumn("steps", F.array_join("steps", ","))


def range_marks_reduce(s: SparkSession, d: str) -> DataFrame:
    return _ranges(s, d)


def stride_metrics(s: SparkSession, d: str) -> DataFrame:
    return labels.stride_metrics(_steps(s, d), derived(s, d, "user_clips")).select("clip_id", "n_steps", *_r("mean_interval_s", "stride_rate", "cadence"))


def step_highlight(s: SparkSession, d: str) -> DataFrame:
    return labels.step_highlight(_steps(s, d), derived(s, d, "user_clips"))


def phase_flags(s: SparkSession, d: str) -> DataFrame:
    return labels.phase_flags(derived(s, d, "hip_short").select("clip_id", "frame"), _steps(s, d)).select("clip_id", "frame", "before_first", "in_approach", "jump")


def mark_frames(s: SparkSession, d: str) -> DataFrame:
    frames = derived(s, d, "hip_short").select("clip_id", "frame")
    return labels.mark_frames(frames, labels.step_highlight(_steps(s, d), derived(s, d, "user_clips")), "near_step")


def approach_summary(s: SparkSession, d: str) -> DataFrame:
    clips, steps, series = derived(s, d, "user_clips"), _steps(s, d), derived(s, d, "hip_short")
    out = labels.approach_summary(clips, hip.hip_droop(series, steps), labels.stride_metrics(steps, clips), steps)
    return out.select("clip_id", "start_frame", "end_frame", *_r("t_start", "t_end"), "n_steps", *_r("stride_rate", "cadence", "hip_droop_pct", "hip_droop_trend_pct"), "n_valid")


def project_tip(s: SparkSession, d: str) -> DataFrame:
    return bend.project_tip(derived(s, d, "bend_marks")).select("clip_id", *_r("tip_x", "tip_y", "l_full"))


def pole_bend(s: SparkSession, d: str) -> DataFrame:
    return bend.pole_bend(derived(s, d, "bend_marks")).select("clip_id", *_r("l_hand_tip", "l_top_hand", "l_full", "l_bent", "bend_fraction", "bend_pct"))


def _mixed(s: SparkSession, d: str, name: str) -> DataFrame:
    return derived(s, d, f"mixed_{name}")


def frame_aligned(s: SparkSession, d: str) -> DataFrame:
    """Every frame of the clips, with its box and its hip where there are any."""
    frames = derived(s, d, "rois").select("clip_id", "frame")
    found = _box(boxes.detect_with_fallback(_mixed(s, d, "detections"), WIDTH, HEIGHT))
    hips = landmarks.hip_series(landmarks.gate_visibility(_lms(s, d)), frames.where("frame % 3 = 0"))
    return landmarks.frame_aligned(frames, found, hips.select("clip_id", "frame", *_r("hip_y")))


def boxes_of_mixed_sizes(s: SparkSession, d: str) -> DataFrame:
    """Boxes and grown boxes where each clip has a frame size of its own."""
    dets = _mixed(s, d, "detections").join(_mixed(s, d, "clips").select("clip_id", "width", "height"), "clip_id")
    grown = boxes.expand_roi(boxes.detect_with_fallback(dets, "width", "height"), "width", "height")
    return grown.select("clip_id", "frame", *[F.col(f"{b}.{c}").alias(f"{b}_{c}") for b in ("box", "roi") for c in ("x1", "y1", "x2", "y2")])


def _ground(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    clips = _mixed(s, d, "clips")
    jobs.co_partitioned(s)
    return jobs.ground_contacts(_mixed(s, d, "detections"), _lms(s, d), contacts.normalize_range(_mixed(s, d, "ranges"), clips), "width", "height", "fps", clips)


def ground_contacts(s: SparkSession, d: str) -> DataFrame:
    return _ground(s, d)[0].select(*FOOT, *_r("x", "y", "v", "t_s"), "contact", "step")


def ground_contacts_summary(s: SparkSession, d: str) -> DataFrame:
    return _ground(s, d)[1].select("clip_id", "foot", "steps", "n_frames", "contact_frames", *_r("total_s", "frequency", "mean_interval_s"))


def approach(s: SparkSession, d: str) -> DataFrame:
    jobs.co_partitioned(s)
    out = jobs.approach(_mixed(s, d, "detections"), _lms(s, d), derived(s, d, "step_marks"), _mixed(s, d, "clips"), "width", "height")
    return out.select("clip_id", "start_frame", "end_frame", *_r("t_start", "t_end"), "n_steps", *_r("stride_rate", "cadence", "hip_droop_pct", "hip_droop_trend_pct"), "n_valid")


def any_foot_guard(s: SparkSession, d: str) -> DataFrame:
    """Clips without any foot height give nothing."""
    lost = F.when(F.col("clip_id") % 5 != 0, F.col("y"))
    return contacts.with_any_foot(_gait(s, d).withColumn("y", lost)).groupBy("clip_id", "foot").agg(F.count("*").alias("frames"))


def display_to_original(s: SparkSession, d: str) -> DataFrame:
    at = lambda c: functions.display_to_original(F.col(c), F.lit(0.75)).alias(c)
    return derived(s, d, "bend_marks").select("clip_id", "step", "click", at("x"), at("y"))


def output_names(s: SparkSession, d: str) -> DataFrame:
    return _clips(s, d).select("clip_id", functions.processed_name(F.col("path")).alias("processed"), functions.contact_overlay_path(F.col("path")).alias("overlay"))


def write_by_clip(s: SparkSession, d: str) -> DataFrame:
    """Signals written in files by clip into the shared folder, and read back with their schema."""
    frames = _gait(s, d)
    path = f"{sources.shared_dir(s)}/signals-{uuid.uuid4().hex}"
    sources.write_by_clip(frames, path, 4)
    return s.read.schema(frames.schema).parquet(path).select(*FOOT, *_r("x", "y"))


def carry_forward_box_in_chunks(s: SparkSession, d: str) -> DataFrame:
    return _box(chunks.carry_forward_box(chunks.chunked(_found(s, d), 100)).drop("_chunk"))


def hip_droop_in_chunks(s: SparkSession, d: str) -> DataFrame:
    """Droop with clips cut into chunks; what lies between is written into the shared folder."""

    def keep(df: DataFrame) -> DataFrame:
        path = f"{sources.shared_dir(s)}/frames-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return s.read.schema(df.schema).parquet(path)

    series = derived(s, d, "hip_short")
    frames, out = chunks.hip_droop(series, keep, _bounds(series), size=20)
    listed = frames.where("worst").groupBy("clip_id").agg(F.array_join(F.sort_array(F.collect_list("frame")), ",").alias("worst_frames"))
    return out.join(listed, "clip_id", "left").select("clip_id", *_r("hip_droop_pct", "hip_droop_trend_pct"), "n_valid", F.coalesce("worst_frames", F.lit("")).alias("worst_frames"), "start_idx", "end_idx")


_ALL = [
    clip_catalog, normalize_clips, frame_sample_plan, sample_output_path, normalize_range, largest_person_box, detect_with_fallback, expand_roi, carry_forward_box, roi_to_frame, gate_visibility,
    norm_to_px, hip_series, foot_series, skeleton_qc, drawable_segments, leg_segments, visible_joints, interpolate_gaps, moving_average, velocity, contact_thresholds, contact_flag, drop_short_runs,
    rising_edges, contact_state, contact_summary, foot_trail, analysis_window, valid_pose_frames, iqr_outlier_flag, hip_baseline, droop_series, worst_frames, hip_droop, hip_trail, step_marks_reduce,
    range_marks_reduce, stride_metrics, step_highlight, phase_flags, mark_frames, approach_summary, project_tip, pole_bend,
    frame_aligned, boxes_of_mixed_sizes, ground_contacts, ground_contacts_summary, approach, any_foot_guard, display_to_original, output_names, write_by_clip,
    carry_forward_box_in_chunks, hip_droop_in_chunks,
]
QUERIES = {f.__name__: f for f in _ALL}
