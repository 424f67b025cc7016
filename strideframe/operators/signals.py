"""Ordered signals of one clip (and foot): gaps, smoothing, speed, thresholds, runs, edges.

All windows partition by the keys and order by frame, so that a table dealt by clip needs no
further exchange. Missing values are null; NaN must be turned into null before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import given, quartile

KEYS = ("clip_id", "foot")


def _orders(keys: tuple[str, ...]) -> tuple[WindowSpec, WindowSpec]:
    return W.partitionBy(*keys).orderBy("frame"), W.partitionBy(*keys).orderBy(F.desc("frame"))


def interpolate_gaps(df: DataFrame, cols: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Nulls between two values become the line through them; before the first and after the
    last value they take that value. A signal without any value is unchanged.

    The next value comes from the descending order, in which it is the last one seen: a frame
    that looks ahead would be scanned anew for each row.
    """
    up, down = _orders(keys)
    past, coming = up.rowsBetween(W.unboundedPreceding, 0), down.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_p", F.row_number().over(up))
    sides = {}
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("_p").alias("p")))
        sides |= {f"_a_{c}": F.last(known, ignorenulls=True).over(past), f"_b_{c}": F.last(known, ignorenulls=True).over(coming)}
    df = df.withColumns(sides)

    def filled(c: str) -> Column:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        line = (b["v"] - a["v"]) / (b["p"] - a["p"]) * (F.col("_p") - a["p"]) + a["v"]
        return F.when(F.col(c).isNotNull(), F.col(c)).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(line)

    return df.withColumns({c: filled(c) for c in cols}).drop("_p", *sides)


def moving_average(df: DataFrame, cols: list[str], window: int = 5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Mean of ``window`` values about each one, the ends repeated beyond them; an even window
    leans left. The terms are summed in order, so that equal inputs give equal bits."""
    if window <= 1:
        return df
    up, down = _orders(keys)
    df = df.withColumns({f"_{end}_{c}": F.first(c).over(o.rowsBetween(W.unboundedPreceding, 0)) for c in cols for end, o in (("lo", up), ("hi", down))})

    def mean(c: str) -> Column:
        total = None
        for k in range(-(window // 2), window - window // 2):
            term = F.coalesce(F.lag(c, -k).over(up), F.col(f"_lo_{c}")) if k < 0 else F.coalesce(F.lead(c, k).over(up), F.col(f"_hi_{c}")) if k else F.col(c)
            total = term if total is None else total + term
        return total / F.lit(float(window))

    return df.withColumns({c: mean(c) for c in cols}).drop(*[f"_{end}_{c}" for c in cols for end in ("lo", "hi")])


def velocity(df: DataFrame, col: str, dt: float | str | Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds v: change a second; the first frame has the second's. A single frame has none.

    ``dt`` is a number of seconds, or a column with each clip's own.
    """
    up, _ = _orders(keys)
    step = F.coalesce(F.col(col) - F.lag(col).over(up), F.lead(col).over(up) - F.col(col))
    return df.withColumn("v", step / given(dt))


def contact_thresholds(df: DataFrame, col: str = "y", height: float = 0.8, speed: float = 0.3, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds y_thr and v_thr: exact percentiles of position and of absolute speed."""
    whole = W.partitionBy(*keys)
    return df.withColumns({"y_thr": F.percentile(col, height).over(whole), "v_thr": F.percentile(F.abs("v"), speed).over(whole)})


def contact_flag(df: DataFrame, col: str = "y") -> DataFrame:
    """Adds contact: low (y grows downward) and slow, bounds included; false where unknown."""
    on = (F.col(col) >= F.col("y_thr")) & (F.abs("v") <= F.col("v_thr"))
    return df.withColumn("contact", F.coalesce(on, F.lit(False)))


def drop_short_runs(df: DataFrame, flag: str, min_len: int = 3, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Runs of true that are shorter than ``min_len`` become false, at a clip's ends too."""
    up, _ = _orders(keys)
    same_flag = W.partitionBy(*keys, flag).orderBy("frame")
    df = df.withColumn("_run", F.row_number().over(up) - F.row_number().over(same_flag))
    size = F.count("*").over(W.partitionBy(*keys, flag, "_run"))
    return df.withColumn("_n", size).withColumn(flag, F.col(flag) & (F.col("_n") >= min_len)).drop("_run", "_n")


def rising_edges(df: DataFrame, flag: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds step: true after false. The first frame is never one."""
    up, _ = _orders(keys)
    return df.withColumn("step", F.coalesce(F.col(flag) & ~F.lag(flag).over(up), F.lit(False)))


def quartiles(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Adds of each column its count and quartiles in the group, ``{col}_n``, ``{col}_low`` and ``{col}_high``, as ``functions.quartile`` has them.

    ``F.percentile`` lies between the same two neighbours, so counts of the values below and up
    to it, and those next to it, give the neighbours exactly. No group is sorted.
    """
    whole = W.partitionBy(*keys)
    shares = {"low": 0.25, "high": 0.75}
    df = df.withColumns({k: v for c in cols for k, v in ((f"{c}_n", F.count(c).over(whole)), (f"{c}_q", F.percentile(c, list(shares.values())).over(whole)))})
    beside, places, found = {}, {}, {}
    for c in cols:
        for i, (side, p) in enumerate(shares.items()):
            x, q, at = F.col(c), F.col(f"{c}_q")[i], F.lit(p) * (F.col(f"{c}_n") - 1)
            below, upto, last, following = (f"{c}_{side}_{s}" for s in ("below", "upto", "last", "next"))
            beside |= {below: F.count(F.when(x < q, 1)).over(whole), upto: F.count(F.when(x <= q, 1)).over(whole), last: F.max(F.when(x < q, x)).over(whole), following: F.min(F.when(x > q, x)).over(whole)}
            ranked = lambda r: F.when(r < F.col(below), F.col(last)).when(r < F.col(upto), q).otherwise(F.col(following))  # noqa: B023, E731
            lower, upper, share = (f"{c}_{side}_{s}" for s in ("lower", "upper", "share"))
            places |= {lower: ranked(F.floor(at)), upper: ranked(F.ceil(at)), share: at - F.floor(at)}
            found[f"{c}_{side}"] = quartile(F.col(lower), F.col(upper), F.col(share))
    return df.withColumns(beside).withColumns(places).withColumns(found).drop(*beside, *places, *[f"{c}_q" for c in cols])


def within_fence(value: Column, low: Column, high: Column, n: Column, fence: float = 1.5, least: int = 5) -> Column:
    """Whether a value lies within the Tukey fence of ``n`` values with these quartiles."""
    spread = high - low
    within = value.between(low - F.lit(fence) * spread, high + F.lit(fence) * spread)
    return F.when((n < least) | (spread < 1e-6), value.isNotNull()).otherwise(F.coalesce(within, F.lit(False)))


def iqr_outlier_flag(df: DataFrame, col: str | list[str], keys: list[str], fence: float = 1.5, least: int = 5) -> DataFrame:
    """Adds ``{col}_in``, of each column: within the Tukey fence of its group, bounds included.

    Groups of fewer than ``least`` values, or of hardly any spread, have no fence.
    """
    cols = [col] if isinstance(col, str) else col
    df = quartiles(df, cols, keys)
    inside = {f"{c}_in": within_fence(F.col(c), F.col(f"{c}_low"), F.col(f"{c}_high"), F.col(f"{c}_n"), fence, least) for c in cols}
    return df.withColumns(inside).drop(*[f"{c}_{s}" for c in cols for s in ("n", "low", "high")])
