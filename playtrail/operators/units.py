"""Units: how often they go into loadouts, which loadouts recur, how far they are upgraded."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrail.functions.numeric import ratio2
from playtrail.functions.texts import clean_loadout, clean_unit_name, split_units
from playtrail.operators.cohort import keep_cohort
from playtrail.operators.filters import Filters, first_rows, level_choice, row_limit
from playtrail.operators.weights import number, times
from playtrail.sources.schema import LOADOUT, UNIT_UPGRADE, USER


def _loadout_events(events: DataFrame, filters: Filters, level: int | str | None) -> DataFrame:
    chosen = level_choice(level)
    starts = filters.on_attributes(events.filter(F.col("event_name") == LOADOUT))
    if chosen is not None:
        starts = starts.filter(F.col("level") == chosen)
    return starts.filter(F.col("unit_names").isNotNull())


def _uses(loadouts: DataFrame, column: str) -> DataFrame:
    return loadouts.groupBy(column).agg(number(loadouts).alias("uses"))


def _loadouts(events: DataFrame, filters: Filters, level: int | str | None) -> DataFrame:
    """Use of each loadout text. Counting before splitting keeps the split to one row per text."""
    starts = _loadout_events(events, filters, level)
    # Without a cohort the user is not needed, and a hot loadout is one row per task at once.
    if not filters.has_cohort:
        return _uses(starts, "unit_names")
    per_user = starts.groupBy(USER, "unit_names").agg(number(events).alias("uses"))
    kept = keep_cohort(per_user, events, filters)
    return kept.groupBy("unit_names").agg(F.sum("uses").alias("uses"))


def _unit_frequency(loadouts: DataFrame) -> DataFrame:
    units = F.col("units")
    # Each position is one use; only the unit's first position in a loadout counts the loadout.
    # A split is never empty; the outer form keeps Spark from testing that on every event, below the
    # aggregation, by splitting each text there too.
    placed = loadouts.select("uses", split_units(F.col("unit_names")).alias("units")).select(
        "uses",
        "units",
        F.posexplode_outer("units").alias("place", "name"),
    )
    is_first = F.array_position(units, F.col("name")) == F.col("place") + 1
    return (
        placed.filter(F.col("name") != "")
        .select("name", "uses", is_first.alias("is_first"))
        .groupBy("name")
        .agg(
            F.sum("uses").alias("usage_count"),
            F.count_if("is_first").alias("unique_loadouts"),
        )
    )


def _top_loadouts(loadouts: DataFrame, k: int | str) -> DataFrame:
    counted = loadouts.select(
        F.col("unit_names").alias("loadout"), F.col("uses").alias("usage_count")
    )
    return first_rows(counted.orderBy(F.desc("usage_count"), "loadout"), k, 20)


def unit_frequency(
    events: DataFrame, filters: Filters = Filters(), level: int | str | None = None
) -> DataFrame:
    """Uses of each unit, and distinct loadouts holding it; blank pieces are left out."""
    return _unit_frequency(_loadouts(events, filters, level)).orderBy(F.desc("usage_count"), "name")


def top_loadouts(
    events: DataFrame, filters: Filters = Filters(), level: int | str | None = None, k: int | str = 20
) -> DataFrame:
    """The k most used loadouts, as raw text: order and spacing of the units matter."""
    return _top_loadouts(_loadouts(events, filters, level), k)


def top_loadouts_by_hash(
    events: DataFrame, filters: Filters = Filters(), level: int | str | None = None, k: int | str = 20
) -> DataFrame:
    """The same as `top_loadouts`, for logs with very many different loadouts, or long ones.

    First, uses are summed by a hash of the text: 16 bytes a loadout are shuffled instead of the
    text. The exact uses of the k most used hashes give a bound that the last of the top k reaches
    at least: the k-th most used text among theirs. Only texts whose hash reaches the bound are then
    counted as texts. Texts of one hash have no more uses than the hash has, so none of the top k is
    missed; where fewer than k texts were found, the bound is 0. Three passes over two columns, so it
    pays where the texts would be most of what is shuffled; where many loadouts tie with the last
    one, all of these are counted as texts.
    """
    count = row_limit(k, 20)
    loadouts = _loadout_events(events, filters, level)
    if filters.has_cohort:
        loadouts = keep_cohort(loadouts, events, filters)
    if count is None:
        return _top_loadouts(_uses(loadouts, "unit_names"), k)
    hashed = loadouts.withColumn("hash", F.xxhash64("unit_names"))
    per_hash = _uses(hashed, "hash")
    most_used = per_hash.orderBy(F.desc("uses"), "hash").limit(count).select("hash")
    first = _uses(hashed.join(most_used, "hash", "left_semi"), "unit_names")
    best = first.orderBy(F.desc("uses")).limit(count)
    bound = best.agg(F.when(F.count("*") == count, F.min("uses")).otherwise(F.lit(0))).scalar()
    able = per_hash.filter(F.col("uses") >= bound).select("hash")
    return _top_loadouts(_uses(hashed.join(able, "hash", "left_semi"), "unit_names"), k)


def unit_loadout(
    events: DataFrame, filters: Filters = Filters(), level: int | str | None = None, k: int | str = 20
) -> DataFrame:
    """Both of the above in one result, told apart by `result_type`."""
    loadouts = _loadouts(events, filters, level)
    units = _unit_frequency(loadouts).select(
        F.lit("unit_frequency").alias("result_type"),
        "name",
        "usage_count",
        F.col("unique_loadouts").alias("additional_info"),
    )
    tops = _top_loadouts(loadouts, k).select(
        F.lit("top_loadouts").alias("result_type"),
        F.col("loadout").alias("name"),
        "usage_count",
        F.lit(None).cast("bigint").alias("additional_info"),
    )
    return units.unionByName(tops).orderBy("result_type", F.desc("usage_count"), "name")


def split_unit_loadout(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two parts of `unit_loadout`: (unit frequency, top loadouts)."""
    kind = F.col("result_type")
    return tagged.filter(kind == "unit_frequency"), tagged.filter(kind == "top_loadouts")


def top_units(frequency: DataFrame, k: int = 15) -> DataFrame:
    """First k bars of the unit chart, number prefix removed from the names."""
    return (
        frequency.orderBy(F.desc("usage_count"), "name")
        .limit(k)
        .withColumn("unit", clean_unit_name(F.col("name")))
    )


def ranked_loadouts(tops: DataFrame, k: int = 20) -> DataFrame:
    """Top loadouts with their place and readable unit names. The window holds the k kept rows."""
    order = Window.orderBy(F.desc("usage_count"), "loadout")
    kept = tops.orderBy(F.desc("usage_count"), "loadout").limit(k)
    return kept.select(
        F.concat(F.lit("#"), F.row_number().over(order).cast("string")).alias("rank"),
        "loadout",
        clean_loadout(F.col("loadout")).alias("units"),
        "usage_count",
    )


def unit_upgrades(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Upgrades per unit and the levels they reached."""
    level = F.col("level")
    upgrades = filters.on_attributes(events.filter(F.col("event_name") == UNIT_UPGRADE)).filter(
        F.col("unit_name").isNotNull() & (F.col("unit_name") != "") & level.isNotNull()
    )
    per_user = upgrades.groupBy(USER, "unit_name").agg(
        number(events).alias("upgrades"),
        F.sum(level * times(events)).alias("levels"),
        F.min("level").alias("lowest"),
        F.max("level").alias("highest"),
    )
    return (
        keep_cohort(per_user, events, filters)
        .groupBy("unit_name")
        .agg(
            F.sum("upgrades").alias("total_upgrades"),
            ratio2(F.sum("levels"), F.sum("upgrades")).alias("avg_upgrade_level"),
            F.min("lowest").alias("min_level"),
            F.max("highest").alias("max_level"),
        )
        .orderBy(F.desc("total_upgrades"), "unit_name")
    )
