"""Numbers typed as text, bands, and bounded Laplace noise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

GRADE_BOUNDARIES = (40, 50, 60, 70, 80, 90)
_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
#: What counts as a number as a whole: decimal with exponent, infinity, and the prefixed integers.
WHOLE = r"^(?:[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+)$"


def parse_float(text: Column) -> Column:
    """The number at the start of a text, null if there is none."""
    return F.nullif(F.regexp_extract(text, _PREFIX, 1), F.lit("")).try_cast("double")


def finite(number: Column) -> Column:
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))


def round_half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def number_text(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def grade_band(value: Column, boundaries: Sequence[float] = GRADE_BOUNDARIES) -> Column:
    """``0-39``, ``40-49``, ... ``90+``; empty for what is not a finite number."""
    b = list(boundaries)
    names = [f"0-{number_text(b[0] - 1)}", *(f"{number_text(x)}-{number_text(y - 1)}" for x, y in zip(b, b[1:])), f"{number_text(b[-1])}+"]
    out = F.lit(names[-1])
    for bound, name in reversed(list(zip(b, names))):
        out = F.when(value < bound, name).otherwise(out)
    return F.when(finite(value), out).otherwise("")


def attendance_band(value: Column) -> Column:
    band = F.when(value < 80, "<80%").when(value < 90, "80-89%").when(value < 95, "90-94%").otherwise("95%+")
    return F.when(finite(value), band).otherwise("")


def noise_band(value: Column, boundaries: Sequence[float], maximum: float) -> Column:
    """Struct (lower, upper) of the half-open band of a value; the last band ends above the maximum."""
    edges = [0.0, *map(float, boundaries), float(maximum) + 1]
    out = F.struct(F.lit(edges[-2]).alias("lower"), F.lit(edges[-1]).alias("upper"))
    for low, high in reversed(list(zip(edges[:-2], edges[1:-1]))):
        out = F.when(value < high, F.struct(F.lit(low).alias("lower"), F.lit(high).alias("upper"))).otherwise(out)
    return out


def laplace(b: float, u: Column) -> Column:
    """Laplace noise around 0 with scale ``b`` from a uniform draw; null where it is infinite."""
    c = u - 0.5
    return F.when(c == 0, 0.0).otherwise(-b * F.signum(c) * F.ln(1 - 2 * F.abs(c)))


def bounded_noise(value: Column, u: Column, maximum: float = 100.0, share: float = 0.05, boundaries: Sequence[float] | None = None) -> Column:
    """Struct (value, failed): the value with whole-number noise that stays within its band.

    A band with fewer than two whole numbers leaves the value as it is and
    counts as failed. A draw of 0 gives the lower clamp.
    """
    most = maximum * share
    noise = F.greatest(F.least(F.coalesce(laplace(most / 2, u), F.lit(-most)), F.lit(most)), F.lit(-most))
    moved = round_half_away(value + noise)
    if boundaries is None:  # the bounds take no part where there is no value
        return F.struct(F.when(value.isNotNull(), F.least(F.greatest(moved, F.lit(0.0)), F.lit(float(maximum)))).alias("value"), F.lit(False).alias("failed"))
    band = noise_band(value, boundaries, maximum)
    low, high = F.ceil(band["lower"]).cast("double"), band["upper"] - 1
    narrow = high - low < 1
    return F.struct(F.when(narrow | value.isNull(), value).otherwise(F.least(F.greatest(moved, low), high)).alias("value"), narrow.alias("failed"))
