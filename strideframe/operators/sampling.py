"""Which frames of a clip to sample, and their file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import safe_name, stem


def frame_sample_plan(clips: DataFrame, fps: float | None = None, every: int | None = None, start: float = 0.0, end: float | None = None) -> DataFrame:
    """One row (clip columns, frame) for each frame to sample; ``fps`` goes before ``every``.

    The stride is the native rate over ``fps``, rounded half to even, 1 at least.
    Clips with an empty range give no rows.
    """
    first = F.greatest(F.lit(0), (F.lit(start) * F.col("fps")).cast("int"))
    last = F.col("total_frames") if end is None else F.least(F.col("total_frames"), (F.lit(end) * F.col("fps")).cast("int"))
    if fps and fps > 0:
        stride = F.greatest(F.lit(1), F.rint(F.col("fps") / F.lit(fps)).cast("int"))
    else:
        stride = F.lit(every if every and every > 0 else 10)
    planned = clips.withColumns({"_first": first, "_last": last, "stride": stride}).where("_last > _first")
    return planned.withColumn("frame", F.explode(F.sequence("_first", F.col("_last") - 1, "stride"))).drop("_first", "_last")


def sample_output_path(plan: DataFrame, out: str, root: str | None = None) -> DataFrame:
    """Adds ``output``: out/stem/stem_f000123.jpg; with ``root`` the path below it names the folder.

    A path outside ``root`` raises.
    """
    name = safe_name(stem(F.col("path")))
    if root is None:
        folder = name
    else:
        below = F.when(F.col("path").startswith(root.rstrip("/") + "/"), F.substring("path", len(root.rstrip("/")) + 2, 1 << 30)).otherwise(F.raise_error(F.concat(F.lit("path outside root: "), "path")))
        folder = F.regexp_replace(below, r"(?<=[^/])\.[^./]+$", "")
    return plan.withColumn("output", F.concat(F.lit(f"{out}/"), folder, F.lit("/"), name, F.format_string("_f%06d.jpg", "frame")))
