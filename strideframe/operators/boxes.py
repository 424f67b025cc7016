"""Person boxes: the largest of a frame, its fallback, clamping, margins, carrying forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bound, clip, given, named

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


SIDES = ("x1", "y1", "x2", "y2")


def _winners(detections: DataFrame, keys: list[str], conf_min: float | None, sides_of: list[str], dealt: bool) -> DataFrame:
    """For each of ``keys`` and each ``area`` that a person's box has: its sides, of the first detection that has it.

    Rows that can't win have a null area, one row for all. ``keys`` come first in the grouping
    and in the dealing, so that grouping by them alone afterwards needs no other exchange.
    Areas, indices and sides are plain numbers, so Spark hashes and never sorts.
    """
    kept = F.col("cls") == 0
    if conf_min is not None:
        kept = kept & (F.col("conf") >= conf_min)
    area = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1")) * F.greatest(F.lit(0.0), F.col("y2") - F.col("y1"))
    rows = detections.select(*keys, "det_idx", *SIDES, *sides_of, F.when(kept & (area > 0), area).alias("area"))
    if not dealt:
        rows = rows.repartition(*[k for k in keys if k != "pass"])
    return rows.groupBy(*keys, "area").agg(*[F.min_by(c, "det_idx").alias(c) for c in SIDES], *[F.max(w).alias(w) for w in sides_of])


def _best(area: Column) -> list[Column]:
    """Sides of the greatest area, one column each."""
    return [F.max_by(c, area) for c in SIDES]


def _inside(prefix: str, width: Column, height: Column) -> dict[str, Column]:
    """Sides ``{prefix}x1`` and so on, cut to the frame in whole pixels."""
    most = {"x1": width - 1, "x2": width, "y1": height - 1, "y2": height}
    return {prefix + c: clip(F.col(prefix + c), 0, most[c]).cast("int") for c in SIDES}


def _some(prefix: str) -> Column:
    return (F.col(f"{prefix}x2") > F.col(f"{prefix}x1")) & (F.col(f"{prefix}y2") > F.col(f"{prefix}y1"))


def _box(*prefixes: str) -> dict[str, Column]:
    """Sides of the first of several cut boxes of which something is left."""
    def side(c: str) -> Column:
        found = F.when(_some(prefixes[0]), F.col(prefixes[0] + c))
        for p in prefixes[1:]:
            found = found.when(_some(p), F.col(p + c))
        return found

    return {f"_{c}": side(c) for c in SIDES}


def _struct(prefix: str, some: Column) -> Column:
    """Sides as one column; null where there is no box."""
    return F.when(some, F.struct(*[F.col(prefix + c).alias(c) for c in SIDES]))


def largest_person_box(detections: DataFrame, width: int | str, height: int | str, conf_min: float | None = None, keys: tuple[str, ...] = ("clip_id", "frame", "pass"), dealt: bool = False) -> DataFrame:
    """``box`` of every (clip, frame, pass): chosen by raw area first, clamped afterwards.

    A chosen box that clamps to nothing gives null, even where a smaller one would be left; of
    equal areas the first detection wins. ``width`` and ``height`` are numbers, or columns of
    the detections with each clip's own. One exchange by clip and frame, none if the
    detections are ``dealt`` by some of these already; two hash aggregations.
    """
    sizes = named(width, height)
    best = _winners(detections, list(keys), conf_min, sizes, dealt).groupBy(*keys).agg(*[c.alias(n) for c, n in zip(_best(F.col("area")), SIDES, strict=True)], *[F.max(w).alias(w) for w in sizes])
    # each step's columns are read several times by the next, so they stay projections of their own
    found = best.withColumns(_inside("", given(width), given(height))).withColumns(_box(""))
    return bound(found, "box", _struct("_", F.col("_x1").isNotNull())).select(*keys, "box")


def detect_with_fallback(detections: DataFrame, width: int | str, height: int | str, conf_min: float | None = None, dealt: bool = False) -> DataFrame:
    """``box`` of every (clip, frame): of the original pass, else of the boosted one, else null.

    Sizes are numbers or columns of the detections; columns stay in the result. Aggregations
    and ``dealt`` as in ``largest_person_box``.
    """
    sizes = named(width, height)
    each = _winners(detections, ["clip_id", "frame", "pass"], conf_min, sizes, dealt)
    passes = {"a_": "original", "b_": "boosted"}
    sides = [c.alias(p + n) for p, name in passes.items() for c, n in zip(_best(F.when(F.col("pass") == name, F.col("area"))), SIDES, strict=True)]
    best = each.groupBy("clip_id", "frame").agg(*sides, *[F.max(w).alias(w) for w in sizes])
    cut = best.withColumns(_inside("a_", given(width), given(height)) | _inside("b_", given(width), given(height)))
    found = cut.withColumns(_box("a_", "b_"))
    return bound(found, "box", _struct("_", F.col("_x1").isNotNull())).select("clip_id", "frame", *sizes, "box")


def expand_roi(boxes: DataFrame, width: int | str, height: int | str, margin: float = 0.3) -> DataFrame:
    """Adds ``roi``: the box grown about its centre, cut to the frame; null if empty.

    Half sizes, centres and sides are columns of their own in turn, so that none of them is
    worked out again for each use.
    """
    b, grow = F.col("box"), F.lit(1.0 + margin)
    halves = {f"_h{c}": ((b[f"{c}2"] - b[f"{c}1"]) * grow).cast("int") / 2 for c in "xy"}
    centres = {f"_c{c}": b[f"{c}1"] + (b[f"{c}2"] - b[f"{c}1"]) / 2 for c in "xy"}
    most = {"x": given(width), "y": given(height)}
    low = {f"_r{c}1": F.greatest(F.lit(0), (F.col(f"_c{c}") - F.col(f"_h{c}")).cast("int")) for c in "xy"}
    high = {f"_r{c}2": F.least(most[c], (F.col(f"_c{c}") + F.col(f"_h{c}")).cast("int")) for c in "xy"}
    grown = boxes.withColumns(halves | centres).withColumns(low | high)
    return bound(grown, "roi", _struct("_r", b.isNotNull() & _some("_r"))).drop(*halves, *centres, *low, *high)


def carry_forward_box(frames: DataFrame) -> DataFrame:
    """Frames without a box take the clip's last one; leading frames stay null."""
    upto = W.partitionBy("clip_id").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    return frames.withColumn("box", F.last("box", ignorenulls=True).over(upto))
