"""Read one parameter from the bag `array<struct<key, value struct<...>>>`.

A lookup is two array reads: the position of the key, then that position in the array of one typed
field. Both generate code, and because only `key` and the one typed field are named, Parquet reads
no other leaf of the bag. A missing key, or a key logged under another type, reads as NULL. Of a
repeated key the first entry counts.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

BAG = "event_params"


def _typed(key: str, field: str, bag: str) -> Column:
    params = F.col(bag)
    slot = (F.array_position(params.getField("key"), F.lit(key)) - 1).cast("int")
    return F.get(params.getField("value").getField(field), slot)


def int_param(key: str, bag: str = BAG) -> Column:
    return _typed(key, "int_value", bag)


def double_param(key: str, bag: str = BAG) -> Column:
    """Double only: an integer under this key reads as NULL."""
    return _typed(key, "double_value", bag)


def number_param(key: str, bag: str = BAG) -> Column:
    """Double, falling back to the integer field."""
    return F.coalesce(double_param(key, bag), int_param(key, bag).cast("double"))


def string_param(key: str, bag: str = BAG) -> Column:
    return _typed(key, "string_value", bag)
