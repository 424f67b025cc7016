"""Bend of an implement from points that people clicked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import segment_length

#: Clicks that each step takes.
CLICKS = {1: 2, 2: 2, 3: 1}


def _points(marks: DataFrame) -> DataFrame:
    """One row a clip with the point of each (step, click); only clips that have them all."""
    point = lambda s, c: F.max(F.when((F.col("step") == s) & (F.col("click") == c), F.struct("x", "y"))).alias(f"p{s}{c}")
    wanted = [(s, c) for s, n in CLICKS.items() for c in range(n)]
    wide = marks.groupBy("clip_id").agg(*[point(s, c) for s, c in wanted])
    return wide.dropna(subset=[f"p{s}{c}" for s, c in wanted])


def plant_orientation(first: Column, second: Column) -> tuple[Column, Column]:
    """(top, hand): the higher click is the top; at equal height the second is."""
    return F.when(first["y"] < second["y"], first).otherwise(second), F.when(first["y"] < second["y"], second).otherwise(first)


def project_tip(marks: DataFrame) -> DataFrame:
    """The hidden tip: from the top through the hand for the implement's whole length.

    Step 1's clicks are hand and tip, step 2's top and hand at the plant, step 3's the top at
    the greatest bend. Null where top and hand coincide.
    """
    p = _points(marks)
    top, hand = plant_orientation(F.col("p20"), F.col("p21"))
    p = p.select("clip_id", "p10", "p11", "p30", top.alias("top"), hand.alias("hand"))
    xy = lambda a, b: segment_length(F.col(f"{a}.x"), F.col(f"{a}.y"), F.col(f"{b}.x"), F.col(f"{b}.y"))
    p = p.withColumns({"l_hand_tip": xy("p10", "p11"), "l_top_hand": xy("top", "hand")})
    p = p.withColumn("l_full", F.col("l_hand_tip") + F.col("l_top_hand"))
    along = lambda c: F.when(F.col("l_top_hand") >= 1e-6, F.col(f"top.{c}") + F.try_divide((F.col(f"hand.{c}") - F.col(f"top.{c}")).cast("double"), F.col("l_top_hand")) * F.col("l_full"))
    return p.withColumns({"tip_x": along("x"), "tip_y": along("y")})


def pole_bend(marks: DataFrame) -> DataFrame:
    """Lengths and bend of every clip with all its marks: 1 less the bent share of the length."""
    t = project_tip(marks)
    bent = segment_length(F.col("tip_x"), F.col("tip_y"), F.col("p30.x"), F.col("p30.y"))
    t = t.withColumn("l_bent", bent).withColumn("bend", F.lit(1.0) - F.try_divide("l_bent", "l_full"))
    return t.select("clip_id", "l_hand_tip", "l_top_hand", "l_full", "l_bent", F.col("bend").alias("bend_fraction"), (F.col("bend") * F.lit(100.0)).alias("bend_pct"))
