"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """x between low and high; null stays null."""
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, _lit(low)), _lit(high)))


def _lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def given(x: Column | str | float) -> Column:
    """A number that holds for all clips, or the name of the column that has each clip's own."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def named(*values: Column | str | float) -> list[str]:
    """Those of ``values`` that are column names."""
    return sorted({v for v in values if isinstance(v, str)})


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds ``value`` as a column that what follows reads and never works out again.

    Filters on a plain expression are moved below it and so repeat it, with all that it is made
    of; a generated column (here of an array of one element) stays where it is.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def quartile(low: Column, high: Column, share: Column) -> Column:
    """What lies ``share`` (a multiple of a quarter) of the way between two neighbouring values, as SQL's quantile_cont has it.

    That is low * (1 - share) + high * share with the first product unrounded, as a fused
    multiply-add gives it; values that lie on a fence need its last bit. Only three quarters of
    ``low`` can be inexact: halves and quarters are exact, and what their sum loses is added back.
    """
    part, rest = low * (1 - share), high * share
    lost = F.when(share == 0.25, low * 0.25 - (part - low * 0.5)).otherwise(F.lit(0.0))
    total = part + rest
    back = total - part
    return F.when(share == 0, low).otherwise(total + ((part - (total - back)) + (rest - back) + lost))


def nan_to_null(x: Column) -> Column:
    """Missing values are null everywhere; NaN would compare as the greatest number."""
    return F.when(F.isnan(x), None).otherwise(x)


def segment_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance as a double."""
    dx, dy = (x1 - x2).cast("double"), (y1 - y2).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def to_px(x: Column, size: Column, clamp: bool = False) -> Column:
    """Normalised coordinate as a pixel, truncated toward zero; clamped to the frame first if asked."""
    return ((clip(x, 0, 1) if clamp else x) * size).cast("int")


def stem(path: Column) -> Column:
    """File name without directories and last suffix."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


#: Endings of overlay names.
_PROCESSED, _OVERLAY = "_pv_processed.mp4", "_foot_contact_overlay.mp4"


def processed_name(path: Column) -> Column:
    """File name of an approach's overlay."""
    return F.concat(stem(path), F.lit(_PROCESSED))


def contact_overlay_path(path: Column) -> Column:
    """Path of a ground contact overlay: beside the clip, its last suffix replaced."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), F.lit(_OVERLAY))


#: Fixed value: the characters that stay in file names.
_SAFE = r"[^A-Za-z0-9_.-]+"


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, _SAFE, "_")


def suffix(path: Column) -> Column:
    """Last suffix in lower case, dot included; a name that only has a leading dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def display_to_original(x: Column, scale: Column) -> Column:
    return F.try_divide(x.cast("double"), scale.cast("double")).cast("int")
