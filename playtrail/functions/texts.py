"""Text helpers for unit names, loadouts and ad labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats that the reports share.
AD_PREFIX = "RV_Watched_"
UNIT_NUMBER = r"^\d+\s*-\s*"


def trim_space(text: Column) -> Column:
    """Strip every kind of Unicode white space; `trim` strips only the space character."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_units(loadout: Column) -> Column:
    return F.transform(F.split(loadout, ","), trim_space)


def clean_unit_name(name: Column) -> Column:
    """'9 - Stinger Drone' -> 'Stinger Drone'."""
    return F.regexp_replace(name, UNIT_NUMBER, "")


def clean_loadout(loadout: Column) -> Column:
    return F.array_join(F.transform(split_units(loadout), clean_unit_name), ", ")


def _drop_first_prefix(event_name: Column) -> Column:
    return F.regexp_replace(event_name, f"^(.*?){AD_PREFIX}", "$1")


def ad_label(event_name: Column) -> Column:
    return F.translate(_drop_first_prefix(event_name), "_", " ")


def short_ad_label(event_name: Column, total_count: Column) -> Column:
    head = F.substring(_drop_first_prefix(event_name), 1, 15)
    return F.concat(head, F.lit(": "), total_count.cast("string"))
