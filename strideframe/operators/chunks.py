"""The signal operators for clips that don't fit one task: chunks of frames, and what passes their borders.

A chunk holds ``size`` frame numbers of a clip (and foot) and is the unit of parallel work.
What a row needs from other chunks, a last known value, a count, some neighbouring values, is
summed up in one row a chunk; windows over these rows, a ``size``-th as many, carry it from
chunk to chunk; a join on (keys, chunk) brings it back. So each operator reads its input twice:
in a chain of them, store what lies between (a checkpoint or a table). Results equal those of ``signals``,
``boxes``, ``contacts`` and ``hip`` for any size. Missing values are null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import given, quartile
from . import hip
from .contacts import time_axis
from .signals import contact_flag, within_fence

KEYS = ("clip_id", "foot")
CLIP = ("clip_id",)
#: Frames of a chunk: a row of some numbers each, so a few MB a task.
FRAMES = 50_000


def _chunk(size: int) -> Column:
    return F.floor(F.col("frame") / size).alias("_chunk")


def _in_chunk(keys: tuple[str, ...], forward: bool = True) -> WindowSpec:
    frame = F.col("frame") if forward else F.desc("frame")
    return W.partitionBy(*keys, "_chunk").orderBy(frame)


def _over_chunks(keys: tuple[str, ...], forward: bool = True) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(F.col("_chunk") if forward else F.desc("_chunk"))


def chunked(df: DataFrame, size: int = FRAMES) -> DataFrame:
    """Adds ``_chunk``; the operators below need it, and leave it there so that they can follow each other."""
    return df.withColumn("_chunk", _chunk(size))


def _with(df: DataFrame, borders: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.join(borders, [*keys, "_chunk"], "left")


def numbered(df: DataFrame, name: str, of: Column | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds how many rows of the clip there are up to each one, or how many for which ``of`` holds."""
    one = F.lit(1) if of is None else F.coalesce(of, F.lit(False)).cast("int")
    totals = df.groupBy(*keys, "_chunk").agg(F.sum(one).alias("_n"))
    before = F.coalesce(F.sum("_n").over(_over_chunks(keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    borders = totals.select(*keys, "_chunk", before.alias("_before"))
    own = F.sum(one).over(_in_chunk(keys).rowsBetween(W.unboundedPreceding, 0))
    return _with(df.withColumn(name, own), borders, keys).withColumn(name, F.col("_before") + F.col(name)).drop("_before")


def carried(df: DataFrame, values: dict[str, Column], forward: bool = True, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds the last value at or before each row, or with ``forward`` false the next at or after it; nulls are no values."""
    order = F.col("frame") if forward else -F.col("frame")
    named = {f"_v{i}": v for i, v in enumerate(values.values())}
    df = df.withColumns(named)
    ends = df.groupBy(*keys, "_chunk").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_e{c}") for c in named])
    earlier = _over_chunks(keys, forward).rowsBetween(W.unboundedPreceding, -1)
    borders = ends.select(*keys, "_chunk", *[F.last(f"_e{c}", ignorenulls=True).over(earlier).alias(f"_b{c}") for c in named])
    upto = _in_chunk(keys, forward).rowsBetween(W.unboundedPreceding, 0)
    own = df.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in named})
    out = _with(own, borders, keys).withColumns({name: F.coalesce(c, f"_b{c}") for name, c in zip(values, named, strict=True)})
    return out.drop(*named, *[f"_b{c}" for c in named])


def neighbours(df: DataFrame, cols: list[str], back: int, ahead: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds ``_halo``: of each column the ``back`` values before the chunk and the ``ahead`` ones after it, and the clip's first and last.

    Every chunk has a row at least, so that as many chunks as values are looked at to either
    side. Also adds ``_row`` and ``_rest``, how many rows of the chunk there are up to this one
    and after it.
    """
    up, down = _in_chunk(keys).rowsBetween(W.unboundedPreceding, 0), _in_chunk(keys, False).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({"_row": F.count("*").over(up), "_rest": F.count("*").over(down) - 1})
    entry = F.struct("frame", *cols)
    ends = df.groupBy(*keys, "_chunk").agg(
        F.sort_array(F.collect_list(F.when(F.col("_row") <= max(ahead, 1), entry))).alias("_head"),
        F.sort_array(F.collect_list(F.when(F.col("_rest") < max(back, 1), entry))).alias("_tail"),
    )
    order = _over_chunks(keys)
    before = F.flatten(F.collect_list("_tail").over(order.rowsBetween(-max(back, 1), -1)))
    after = F.flatten(F.collect_list("_head").over(order.rowsBetween(1, max(ahead, 1))))
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    borders = ends.select(*keys, "_chunk", F.struct(before.alias("before"), after.alias("after"), F.first(F.element_at("_head", 1)).over(whole).alias("first"), F.last(F.element_at("_tail", -1)).over(whole).alias("last")).alias("_halo"))
    return _with(df, borders, keys)


def _shifted(c: str, k: int, keys: tuple[str, ...]) -> Column:
    """The value ``k`` rows on (before, if negative), in this chunk or the halo; null beyond the clip."""
    if k == 0:
        return F.col(c)
    order = _in_chunk(keys)
    if k < 0:
        out = F.try_element_at("_halo.before", (F.col("_row") + k - 1).cast("int"))
        return F.when(F.col("_row") > -k, F.lag(c, -k).over(order)).otherwise(out[c])
    out = F.try_element_at("_halo.after", (F.lit(k) - F.col("_rest")).cast("int"))
    return F.when(F.col("_rest") >= k, F.lead(c, k).over(order)).otherwise(out[c])


def interpolate_gaps(df: DataFrame, cols: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """As ``signals.interpolate_gaps``: lines between known values, the ends held."""
    df = numbered(df, "_p", keys=keys)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("_p").alias("p"))) for c in cols}
    df = carried(df, {f"_a_{c}": v for c, v in known.items()}, True, keys)
    df = carried(df, {f"_b_{c}": v for c, v in known.items()}, False, keys)

    def filled(c: str) -> Column:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        line = (b["v"] - a["v"]) / (b["p"] - a["p"]) * (F.col("_p") - a["p"]) + a["v"]
        return F.when(F.col(c).isNotNull(), F.col(c)).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(line)

    return df.withColumns({c: filled(c) for c in cols}).drop("_p", *[f"_{s}_{c}" for s in "ab" for c in cols])


def moving_average(df: DataFrame, cols: list[str], window: int = 5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """As ``signals.moving_average``: the terms summed in order, the ends repeated."""
    if window <= 1:
        return df
    back, ahead = window // 2, window - 1 - window // 2
    df = neighbours(df, cols, back, ahead, keys)

    def mean(c: str) -> Column:
        total = None
        for k in range(-back, ahead + 1):
            term = F.coalesce(_shifted(c, k, keys), F.col("_halo")["first" if k < 0 else "last"][c]) if k else F.col(c)
            total = term if total is None else total + term
        return total / F.lit(float(window))

    return df.withColumns({c: mean(c) for c in cols}).drop("_halo", "_row", "_rest")


def velocity(df: DataFrame, col: str, dt: float | str | Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """As ``signals.velocity``: change a second; the first frame has the second's."""
    df = neighbours(df, [col], 1, 1, keys)
    step = F.coalesce(F.col(col) - _shifted(col, -1, keys), _shifted(col, 1, keys) - F.col(col))
    return df.withColumn("v", step / given(dt)).drop("_halo", "_row", "_rest")


def drop_short_runs(df: DataFrame, flag: str, min_len: int = 3, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """As ``signals.drop_short_runs``: a run reaches from the last row that isn't true to the next one, over any borders."""
    df = numbered(df, "_p", keys=keys)
    off = F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col("_p"))
    df = carried(carried(df, {"_from": off}, True, keys), {"_to": off}, False, keys)
    sizes = df.groupBy(*keys, "_chunk").agg(F.max("_p").alias("_last"))
    end = sizes.select(*keys, "_chunk", F.max("_last").over(W.partitionBy(*keys)).alias("_last"))
    length = F.coalesce("_to", F.col("_last") + 1) - F.coalesce("_from", F.lit(0)) - 1
    return _with(df, end, keys).withColumn(flag, F.col(flag) & (length >= min_len)).drop("_p", "_from", "_to", "_last")


def rising_edges(df: DataFrame, flag: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """As ``signals.rising_edges``: true after false; the clip's first frame is never one."""
    df = neighbours(df, [flag], 1, 0, keys)
    return df.withColumn("step", F.coalesce(F.col(flag) & ~_shifted(flag, -1, keys), F.lit(False))).drop("_halo", "_row", "_rest")


def carry_forward_box(frames: DataFrame) -> DataFrame:
    """As ``boxes.carry_forward_box``, over frames with ``_chunk``."""
    return carried(frames.withColumnRenamed("box", "_box"), {"box": F.col("_box")}, True, ("clip_id",)).drop("_box")


def told(df: DataFrame, values: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds what ``values`` has for each clip, by clip and chunk, so that a clip's rows never meet in one task.

    Rows of clips without values get nulls. Without ``_chunk`` rows are joined by clip alone.
    """
    if "_chunk" not in df.columns:
        return df.join(values, list(keys), "left")
    each = df.select(*keys, "_chunk").distinct().join(values, list(keys))
    return _with(df, each, keys)


def _narrowed(rows: DataFrame, brackets: DataFrame, keys: tuple[str, ...], bins: int, rounds: int) -> DataFrame:
    """``brackets`` (keys, ``_r`` with a rank, from least ``_a`` to greatest ``_b`` value, ``_before`` values below) closed in on the value of each rank, in ``_a``."""
    for k in range(rounds + 1):
        asked = brackets.groupBy(*keys).agg(F.collect_list(F.struct("_a", "_b", "_before", "_r")).alias("_asked"))
        inside = told(rows, asked, keys).select(*keys, "_v", F.inline("_asked")).where("_v >= _a AND _v <= _b")
        share = (F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a"))
        each = F.col("_v") if k == rounds else F.when(F.col("_b") > F.col("_a"), F.least(F.lit(bins - 1).cast("long"), F.floor(share * bins))).otherwise(F.lit(0).cast("long"))
        counts = inside.groupBy(*keys, "_r", "_before", each.alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        upto = F.sum("_n").over(W.partitionBy(*keys, "_r").orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
        summed = counts.withColumn("_upto", F.col("_before") + upto)
        found = summed.where((F.col("_upto") - F.col("_n") <= F.col("_r.rank")) & (F.col("_r.rank") < F.col("_upto")))
        brackets = found.select(*keys, "_a", "_b", (F.col("_upto") - F.col("_n")).alias("_before"), "_r")
    return brackets


def _valued(df: DataFrame, value: Column, keys: tuple[str, ...]) -> DataFrame:
    return df.select(*keys, *[c for c in df.columns if c == "_chunk"], value.alias("_v")).where("_v IS NOT NULL")


def _sides(*ranks: Column) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("side"), r.cast("long").alias("rank")) for i, r in enumerate(ranks)])).alias("_r")


def percentile(df: DataFrame, name: str, value: Column, p: float, keys: tuple[str, ...] = KEYS, bins: int = 2048, rounds: int = 2, between: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """(keys, ``name``): the exact percentile of each group, as ``F.percentile`` has it, without holding a group's values.

    ``between`` says what lies a share of the way between two neighbouring values, where that is to differ in its last bits.

    A histogram finds the bin of each of the two ranks that it lies between, a finer one of
    that bin's values the next, ``rounds`` times; only what is left then, values of one bin, is
    counted one by one. ``df`` is read some times a round, so keep it if it is costly. Nulls
    don't count; a group of nulls has no row.
    """
    rows = _valued(df, value, keys)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    sizes = sizes.withColumn("_at", F.lit(p) * (F.col("_n") - 1))
    brackets = sizes.select(*keys, "_a", "_b", F.lit(0).cast("long").alias("_before"), _sides(F.floor("_at"), F.ceil("_at")))
    side = lambda i: F.max(F.when(F.col("_r.side") == i, F.col("_a")))
    both = _narrowed(rows, brackets, keys, bins, rounds).groupBy(*keys).agg(side(0).alias("_lo"), side(1).alias("_hi"))
    both = both.join(sizes.select(*keys, "_at"), list(keys))
    line = (F.ceil("_at") - F.col("_at")) * F.col("_lo") + (F.col("_at") - F.floor("_at")) * F.col("_hi")
    if between is not None:
        line = between(F.col("_lo"), F.col("_hi"), F.col("_at") - F.floor("_at"))
    return both.select(*keys, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).when(F.ceil("_at") == F.floor("_at"), F.col("_lo")).otherwise(line).alias(name))


def ranked_value(df: DataFrame, name: str, value: Column, rank: Column, keys: tuple[str, ...] = KEYS, bins: int = 2048, rounds: int = 2) -> DataFrame:
    """(keys, ``name``): the value of a rank of each group (from 0, least first), found as ``percentile`` does.

    ``rank`` is made of ``_n``, how many values the group has; a rank beyond them has no row.
    """
    rows = _valued(df, value, keys)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    brackets = sizes.select(*keys, "_a", "_b", F.lit(0).cast("long").alias("_before"), _sides(rank))
    return _narrowed(rows, brackets, keys, bins, rounds).select(*keys, F.col("_a").alias(name))


def contact_thresholds(df: DataFrame, col: str = "y", height: float = 0.8, speed: float = 0.3, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """As ``signals.contact_thresholds``: exact percentiles of position and of absolute speed. ``df`` is read several times."""
    found = percentile(df, "y_thr", F.col(col), height, keys).join(percentile(df, "v_thr", F.abs("v"), speed, keys), list(keys), "full")
    return told(df, found, keys)


def find_contacts(feet: DataFrame, fps: float | str, keep: Callable[[DataFrame], DataFrame], window: int = 5, min_len: int = 3, size: int = FRAMES) -> DataFrame:
    """As ``contacts.find_contacts``, for clips of any length.

    ``keep`` stores what lies between steps, each of which reads its input twice: as a rule
    ``lambda df: df.checkpoint()``, with a checkpoint folder that all executors share.
    """
    known = feet.where("y IS NOT NULL").select("clip_id").distinct()
    raw = feet.join(known, "clip_id", "left_semi").withColumns({"x_raw": F.col("x"), "y_raw": F.col("y")})
    dt = F.when(given(fps) > 0, F.try_divide(F.lit(1.0), given(fps).cast("double")))
    filled = keep(interpolate_gaps(keep(chunked(raw, size)), ["x", "y"]))
    moving = keep(velocity(keep(moving_average(filled, ["x", "y"], window)), "y", dt))
    flagged = keep(contact_flag(contact_thresholds(moving)).drop("y_thr", "v_thr"))
    return time_axis(rising_edges(keep(drop_short_runs(flagged, "contact", min_len)), "contact"), fps).drop("_chunk")


def hip_baseline(counted: DataFrame) -> DataFrame:
    """(clip_id, base_hip, base_height): as ``hip.hip_baseline``, of the frames that are ``early``. ``counted`` is read several times."""
    early = lambda c: F.when(F.col("early"), F.col(c))
    fences = counted.groupBy("clip_id").agg(F.count(early("hip_y")).alias("_n"))
    for c in ("hip_y", "body_h"):
        for side, p in (("low", 0.25), ("high", 0.75)):
            fences = fences.join(percentile(counted, f"_{c}_{side}", early(c), p, CLIP, between=quartile), "clip_id", "left")
    rows = told(counted.where("early"), fences, CLIP)
    inside = [within_fence(F.col(c), F.col(f"_{c}_low"), F.col(f"_{c}_high"), F.col("_n")) for c in ("hip_y", "body_h")]
    mean = lambda c: F.coalesce(F.avg(F.when(inside[0] & inside[1], F.col(c))), F.avg(c))
    return rows.groupBy("clip_id").agg(mean("hip_y").alias("base_hip"), mean("body_h").alias("base_height"))


def worst_frames(drooped: DataFrame, share: float = 0.05) -> DataFrame:
    """Adds worst: among the ``share`` of a clip's late frames that droop most, ties by later frame; nothing is sorted.

    The droop of the last place is found as a percentile is; frames above it are worst, and of
    those at it the latest, as many as places are left. ``drooped`` is read several times.
    """
    droop = F.when(F.col("late") & (F.col("n_valid") >= 3), F.col("droop"))
    places = hip.worst_size(F.col("_n"), share)
    least = ranked_value(drooped, "_least", droop, F.col("_n") - places, CLIP)
    rows = numbered(told(drooped, least, CLIP), "_at", droop == F.col("_least"), CLIP)
    number = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    left = rows.groupBy("clip_id").agg(F.count(droop).alias("_n"), number(droop > F.col("_least")).alias("_above"), number(droop == F.col("_least")).alias("_ties"))
    left = left.select("clip_id", (F.col("_ties") - (places - F.col("_above"))).alias("_early_ties"))
    worst = (droop > F.col("_least")) | ((droop == F.col("_least")) & (F.col("_at") > F.col("_early_ties")))
    return told(rows, left, CLIP).withColumn("worst", F.coalesce(worst, F.lit(False))).drop("_least", "_at", "_early_ties")


def hip_droop(series: DataFrame, keep: Callable[[DataFrame], DataFrame], bounds: DataFrame | None = None, clips: DataFrame | None = None, size: int = FRAMES) -> tuple[DataFrame, DataFrame]:
    """(frames, summary): as ``hip.hip_droop``, for clips of any length, with the worst frames as a flag instead of a list.

    ``frames`` adds valid, early, late, droop and worst to ``series``. ``keep`` as in
    ``find_contacts``. An empty table gives a row for each of ``clips``.
    """
    rows = keep(chunked(series, size))
    spans = rows.groupBy("clip_id").agg(F.count("*").cast("int").alias("_frames"))
    if bounds is not None:
        spans = spans.join(bounds.select("clip_id", "first_step", "last_step"), "clip_id", "left")
    else:
        spans = spans.withColumns({c: F.lit(None).cast("int") for c in ("first_step", "last_step")})
    spans = spans.withColumns(hip.window_of(F.col("_frames"))).select("clip_id", "start_idx", "end_idx")
    valid = told(rows, spans, CLIP).withColumn("valid", hip.counts_in_window())
    rows = keep(numbered(valid, "_upto", F.col("valid"), CLIP))
    sizes = rows.groupBy("clip_id").agg(F.count_if("valid").cast("int").alias("n_valid"))
    n, rank = F.col("n_valid"), F.col("_upto") - 1
    rows = told(rows, sizes, CLIP).withColumns({"early": F.col("valid") & (rank < hip.baseline_size(n)), "late": F.col("valid") & (rank >= F.floor(n / 2))})
    rows = keep(rows.drop("_upto"))
    # what is compared later must not be worked out anew: sums of other orders differ
    drooped = keep(hip.droop_series(told(rows, hip_baseline(rows), CLIP)))
    marked = keep(worst_frames(drooped))
    mean = lambda flag: F.avg(F.when(F.col(flag), F.col("droop")))
    out = marked.groupBy("clip_id").agg(
        mean("worst").alias("hip_droop_pct"), (mean("late") - mean("early")).alias("hip_droop_trend_pct"), F.max("n_valid").alias("n_valid"), F.max("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")
    )
    if clips is not None:
        out = clips.select("clip_id").distinct().join(out, "clip_id", "left").fillna(0, ["n_valid", "start_idx", "end_idx"])
    frames = marked.select(*series.columns, "valid", "early", "late", "droop", "worst")
    return frames, out.select("clip_id", "hip_droop_pct", "hip_droop_trend_pct", "n_valid", "start_idx", "end_idx")
