"""Numbers as the evidence tables need them: coercion, rounding half to even, fixed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """Numeric coercion: what is no number, and NaN, is null."""
    d = value.try_cast("double")
    return F.when(~F.isnan(d), d)


def fixed(value: Column, places: int) -> Column:
    """Text with ``places`` decimals, rounded half to even."""
    return F.format_string(f"%.{places}f", F.bround(value, places))


def rounded(value: Column, places: int) -> Column:
    """``round`` of a double, without its decimal number where the value isn't near a tie. The product's rounding is below 2**-12 here, and a whole
    number over a power of ten is the double nearest to that decimal, so both ways give the same bits."""
    scale = float(10**places)
    times = value * scale
    plain = (F.abs(times) < 2.0**40) & (F.abs(times - F.floor(times) - 0.5) > 2.0**-12)
    return F.when(plain, F.floor(times + 0.5) / scale).otherwise(F.round(value, places))


def percent(value: Column) -> Column:
    return F.concat(F.format_string("%.0f", F.bround(value * 100, 0)), F.lit("%"))


def clip01(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def whole(value: Column) -> Column:
    """An integer of a number's text, cut toward zero."""
    return number(value).try_cast("int")
