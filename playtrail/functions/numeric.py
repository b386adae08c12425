"""Number helpers: two-decimal rounding and ratios that never divide by zero."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(value: Column) -> Column:
    """Two decimals, halves away from zero, as a double.

    The detour over a nine-digit decimal drops the last bits of a floating sum, so a mean that is
    exactly x.xx5 rounds the same way whatever order its terms were added in. What no decimal can
    hold (NaN, infinities, 1e29 and more) stays as it is.
    """
    rounded = F.round(value.try_cast("decimal(38,9)"), 2).cast("double")
    return F.coalesce(rounded, value.cast("double"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; NULL where whole is 0."""
    return part.cast("double") / F.nullif(whole, F.lit(0))


def ratio2(part: Column, whole: Column) -> Column:
    return round2(ratio(part, whole))


def percent2(part: Column, whole: Column) -> Column:
    return round2(part.cast("double") * F.lit(100.0) / F.nullif(whole, F.lit(0)))
