"""The nested event log and the names it uses."""

from pyspark.sql import types as T

# Event and parameter names of the log.
FIRST_OPEN = "first_open"
LEVEL_START = "level_start"
LEVEL_COMPLETE = "level_complete"
LEVEL_FAIL = "level_fail"
LOADOUT = "battle_start_loadout"
UNIT_UPGRADE = "unit_upgrade"
BOX_OPENED = "booster_box_opened"
BASE_UPGRADE = "base_station_upgrade"
AD_IMPRESSION = "ad_impression"
REWARDED_AD_PATTERN = "RV_Watched_%"
REWARDED_ADS = (
    "RV_Watched_Victory_Pack",
    "RV_Watched_Defeat_Pack",
    "RV_Watched_Silver_Coin_Before_Game",
    "RV_Watched_Silver_Coin_In_Game",
    "RV_Watched_BoosterBox",
    "RV_Watched_Daily_Spin_Wheel",
    "RV_Watched_Daily_Spin_Wheel_2X",
    "RV_Watched_Coins_Shop",
    "RV_Watched_Daily_Offer_Refresh",
)
SILVER_COIN_ADS = ("RV_Watched_Silver_Coin_Before_Game", "RV_Watched_Silver_Coin_In_Game")
BASE_SKILLS = ("Attack", "Health", "CoinGeneration")
AD_FORMATS = ("INTER", "REWARDED")
BOX_KEY = "booster_box_ID"
OLD_BOX_KEY = "id"

USER = "user_pseudo_id"

PARAM_VALUE = T.StructType(
    [
        T.StructField("string_value", T.StringType()),
        T.StructField("int_value", T.LongType()),
        T.StructField("float_value", T.FloatType()),
        T.StructField("double_value", T.DoubleType()),
    ]
)
PARAM = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", PARAM_VALUE)])

RAW_EVENT = T.StructType(
    [
        T.StructField(USER, T.StringType()),
        T.StructField("event_timestamp", T.LongType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("geo", T.StructType([T.StructField("country", T.StringType())])),
        T.StructField("app_info", T.StructType([T.StructField("version", T.StringType())])),
        T.StructField("event_params", T.ArrayType(PARAM)),
    ]
)
# What the readers ask for: an id where the files have one (NULL otherwise), and, of a log kept by
# day, the day of the directory. That day may be a local one; the day of an event is its UTC day.
READ_EVENT = T.StructType([*RAW_EVENT.fields, T.StructField("event_id", T.LongType())])
READ_EVENT_BY_DAY = T.StructType([*READ_EVENT.fields, T.StructField("event_date", T.DateType())])

FLAT_EVENT = T.StructType(
    [
        T.StructField(USER, T.StringType()),
        T.StructField("event_timestamp", T.LongType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("level", T.LongType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("duration_seconds_dbl", T.DoubleType()),
        T.StructField("unit_names", T.StringType()),
        T.StructField("unit_name", T.StringType()),
        T.StructField("box_id", T.StringType()),
        T.StructField("skill", T.StringType()),
        T.StructField("ad_format", T.StringType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("event_date", T.DateType()),
    ]
)
# The flat table also tells which load a row came with.
STORED_EVENT = T.StructType([*FLAT_EVENT.fields, T.StructField("load_id", T.StringType())])
