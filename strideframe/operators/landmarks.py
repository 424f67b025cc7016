"""Body landmarks: coordinates, gates, per-frame series, skeleton checks and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import given, named, to_px

#: Landmark ids of the public 33-point pose model (fixed values).
NOSE, L_HIP, R_HIP, L_KNEE, R_KNEE, L_ANKLE, R_ANKLE, L_FOOT, R_FOOT = 0, 23, 24, 25, 26, 27, 28, 31, 32
JOINTS = {"l_hip": L_HIP, "r_hip": R_HIP, "l_knee": L_KNEE, "r_knee": R_KNEE, "l_ankle": L_ANKLE, "r_ankle": R_ANKLE}
LEG_EDGES = [("l_hip", "r_hip"), ("l_hip", "l_knee"), ("l_knee", "l_ankle"), ("r_hip", "r_knee"), ("r_knee", "r_ankle")]


def roi_to_frame(landmarks: DataFrame, boxes: DataFrame, width: int | str, height: int | str, every: bool = False) -> DataFrame:
    """x and y from shares of the box to shares of the frame; only landmarks that have a box.

    ``width`` and ``height`` are numbers, or columns of ``boxes`` with each clip's own, which stay.
    With ``every``, each row of ``boxes`` is there, with its other columns: frames without a box
    or a landmark have one row of null lm_id, x and y.
    """
    b = F.col("box")
    if every:
        joined = boxes.join(landmarks, ["clip_id", "frame"], "left")
    else:
        joined = landmarks.join(boxes.where("box IS NOT NULL").select("clip_id", "frame", "box", *named(width, height)), ["clip_id", "frame"])
    x = (b["x1"] + F.col("x") * (b["x2"] - b["x1"])) / given(width).cast("double")
    y = (b["y1"] + F.col("y") * (b["y2"] - b["y1"])) / given(height).cast("double")
    return joined.withColumns({"x": x, "y": y}).drop("box")


def gate_visibility(landmarks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """x and y are null unless visibility is above the threshold."""
    seen = F.col("visibility") > threshold
    return landmarks.withColumns({"x": F.when(seen, F.col("x")), "y": F.when(seen, F.col("y"))})


def norm_to_px(df: DataFrame, width: int | str, height: int | str, clamp: bool = False) -> DataFrame:
    """Adds px, py; both null if either coordinate is missing."""
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return df.withColumns({"px": F.when(both, to_px(F.col("x"), given(width), clamp)), "py": F.when(both, to_px(F.col("y"), given(height), clamp))})


def _of(lm: int, value: str) -> Column:
    return F.max(F.when(F.col("lm_id") == lm, F.col(value)))


def hip_series(landmarks: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """hip_y and body_h of every frame of ``frames``; null where there is no pose.

    Without ``frames``, the frames are those that have a row, be it one without a landmark.
    Only the five landmarks needed are aggregated, with map-side combine.
    """
    needed = landmarks.where(F.col("lm_id").isNull() | F.col("lm_id").isin(NOSE, L_HIP, R_HIP, L_ANKLE, R_ANKLE))
    hip = F.lit(0.5) * (_of(L_HIP, "y") + _of(R_HIP, "y"))
    ankles = F.when(_of(L_ANKLE, "y").isNotNull() & _of(R_ANKLE, "y").isNotNull(), F.greatest(_of(L_ANKLE, "y"), _of(R_ANKLE, "y")))
    series = needed.groupBy("clip_id", "frame").agg(hip.alias("hip_y"), (ankles - _of(NOSE, "y")).alias("body_h"))
    return series if frames is None else frames.select("clip_id", "frame").join(series, ["clip_id", "frame"], "left")


def foot_series(landmarks: DataFrame, frames: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(clip_id, foot, frame, x, y) of both feet from gated landmarks.

    Every frame of ``frames`` has both feet, null where there is no pose; without it, the
    frames are those that have a foot's landmark or a row without one (null lm_id). Other
    columns of ``frames`` stay, or those of the landmarks named in ``keep``, one value a frame.
    """
    needed = landmarks.where(F.col("lm_id").isNull() | F.col("lm_id").isin(L_FOOT, R_FOOT))
    more = list(keep)
    wide = needed.groupBy("clip_id", "frame").agg(*[_of(lm, c).alias(f"{foot}_{c}") for foot, lm in (("left", L_FOOT), ("right", R_FOOT)) for c in "xy"], *[F.max(c).alias(c) for c in more])
    if frames is not None:
        more = [c for c in frames.columns if c not in wide.columns and c != "box"]
        wide = frames.select("clip_id", "frame", *more).join(wide, ["clip_id", "frame"], "left")
    feet = [F.struct(F.lit(f).alias("foot"), F.col(f"{f}_x").alias("x"), F.col(f"{f}_y").alias("y")) for f in ("left", "right")]
    return wide.select("clip_id", "frame", *more, F.explode(F.array(*feet)).alias("f")).select("clip_id", "f.foot", "frame", "f.x", "f.y", *more)


def joint_points(landmarks: DataFrame) -> DataFrame:
    """One row a frame with the six leg joints as (x, y)."""
    needed = landmarks.where(F.col("lm_id").isin(*JOINTS.values()))
    return needed.groupBy("clip_id", "frame").agg(*[_of(lm, c).alias(f"{name}_{c}") for name, lm in JOINTS.items() for c in ("px", "py")])


def skeleton_qc(landmarks: DataFrame, rois: DataFrame, width: int | str, height: int | str, tolerance: float = 2.0) -> DataFrame:
    """Whether a frame's skeleton fits its region: size, centre, and joints outside it."""
    px, py = F.col("x") * given(width).cast("double"), F.col("y") * given(height).cast("double")
    r = F.col("roi")
    outside = (px < r["x1"] - tolerance) | (px > r["x2"] + tolerance) | (py < r["y1"] - tolerance) | (py > r["y2"] + tolerance)
    joined = landmarks.join(rois.where("roi IS NOT NULL").select("clip_id", "frame", "roi"), ["clip_id", "frame"])
    boxed = joined.groupBy("clip_id", "frame").agg(F.min(px).alias("x1"), F.max(px).alias("x2"), F.min(py).alias("y1"), F.max(py).alias("y2"), F.avg(outside.cast("double")).alias("outside"), F.first("roi").alias("roi"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rw, rh = (r["x2"] - r["x1"]).cast("double"), (r["y2"] - r["y1"]).cast("double")
    dx = F.abs((F.col("x1") + F.col("x2")) / 2 - (r["x1"] + r["x2"]) / F.lit(2.0))
    dy = F.abs((F.col("y1") + F.col("y2")) / 2 - (r["y1"] + r["y2"]) / F.lit(2.0))
    flags = {"too_big": (w > F.lit(1.8) * rw) | (h > F.lit(1.8) * rh), "too_small": h < F.lit(0.25) * rh, "off_centre": (dx > F.lit(0.6) * rw) | (dy > F.lit(0.6) * rh), "mostly_outside": F.col("outside") > 0.30}
    flagged = boxed.withColumns(flags)
    bad = F.lit(False)
    for name in flags:
        bad = bad | F.col(name)
    return flagged.select("clip_id", "frame", *flags, "outside", (~bad).alias("accept"))


def _inside(px: Column, py: Column, width: int | str, height: int | str) -> Column:
    return (px >= 0) & (px < given(width)) & (py >= 0) & (py < given(height))


def drawable_segments(landmarks_px: DataFrame, edges: list[tuple[int, int]], width: int | str, height: int | str, visible: float = 0.1) -> DataFrame:
    """Skeleton edges whose ends both exist, are visible and lie inside the frame.

    Landmarks of a frame meet in one map, so that there is one aggregation and no self-join;
    ``edges`` is the pose model's fixed list of (start_id, end_id), some dozens.
    """
    usable = landmarks_px.where((F.col("visibility") >= visible) & _inside(F.col("px"), F.col("py"), width, height))
    frames = usable.groupBy("clip_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct("lm_id", F.struct("px", "py")))).alias("at"))
    ends = frames.withColumn("edge", F.explode(_edge_array(edges)))
    a, b = F.try_element_at("at", F.col("edge.start_id")), F.try_element_at("at", F.col("edge.end_id"))
    return ends.where(a.isNotNull() & b.isNotNull()).select("clip_id", "frame", "edge.start_id", "edge.end_id", a["px"].alias("x1"), a["py"].alias("y1"), b["px"].alias("x2"), b["py"].alias("y2"))


def _edge_array(edges: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("start_id"), F.lit(b).alias("end_id")) for a, b in edges])


def leg_segments(points: DataFrame) -> DataFrame:
    """The five leg edges of each frame of ``joint_points`` that have both ends."""
    each = [F.struct(F.lit(f"{a}-{b}").alias("edge"), *[F.col(f"{p}_{c}").alias(f"{c[1]}{i}") for i, p in ((1, a), (2, b)) for c in ("px", "py")]) for a, b in LEG_EDGES]
    rows = points.select("clip_id", "frame", F.explode(F.array(*each)).alias("e")).select("clip_id", "frame", "e.*")
    return rows.where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")


def visible_joints(landmarks_px: DataFrame, width: int | str, height: int | str) -> DataFrame:
    """Joints inside the frame, whatever their visibility."""
    return landmarks_px.where(_inside(F.col("px"), F.col("py"), width, height))


def frame_aligned(frames: DataFrame, *others: DataFrame) -> DataFrame:
    """Every frame, with the columns of the other tables where they have it."""
    for other in others:
        frames = frames.join(other, ["clip_id", "frame"], "left")
    return frames
