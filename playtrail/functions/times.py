"""Epoch-microsecond time. Everything is UTC, zone-free and integer: no result depends on
`spark.sql.session.timeZone`."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def to_timestamp_ntz(micros: Column) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", micros, epoch)


def slice_of(micros: Column, width: int) -> Column:
    """Number of the `width`-microsecond slice holding the instant (floor, also before 1970)."""
    return ((micros - F.pmod(micros, F.lit(width))) / width).cast("bigint")


def utc_date(micros: Column) -> Column:
    return F.date_from_unix_date(slice_of(micros, DAY).cast("int"))


def second_text(micros: Column) -> Column:
    """'2024-01-31 23:59:59'. `date_format` would go through the session zone, and casting to text
    does not."""
    return F.substring(to_timestamp_ntz(micros).cast("string"), 1, 19)


def clock_text(micros: Column) -> Column:
    """Time of day with microseconds, as text; Spark 4.1 cannot cast a timestamp to TIME."""
    fraction = F.lpad(F.pmod(micros, F.lit(SECOND)).cast("string"), 6, "0")
    return F.concat(F.substring(second_text(micros), 12, 8), F.lit("."), fraction)


def whole(micros: Column, unit: int) -> Column:
    """Whole units in a span of microseconds, truncated toward zero."""
    return ((micros - micros % unit) / unit).cast("bigint")


def elapsed(later: Column, earlier: Column, unit: int = SECOND) -> Column:
    return whole(later - earlier, unit)


def duration_text(seconds: Column) -> Column:
    """'D days, H hours, M minutes'; NULL stays NULL (format_string would print 'null')."""
    days = whole(seconds, 86400)
    hours = whole(seconds, 3600) % 24
    minutes = whole(seconds, 60) % 60
    text = F.format_string("%d days, %d hours, %d minutes", days, hours, minutes)
    return F.when(seconds.isNotNull(), text)
