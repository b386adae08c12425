"""Event log made from the sample tables `events` and `nation`.

`sample_events` is the flat log, the form in which the reports read a stored log.
`raw_sample_events` is the same log as nested events; flattening it gives the flat log again, which
the registered reports `flat_events` and `*_raw` do over the whole table.
"""

from pyspark.sql import DataFrame, SparkSession

from playtrail.sources import schema as S

# Given schemas save reading file footers before the plan is made.
EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string"
)
NATION = "n_nationkey int, n_name string, n_regionkey int"

PURCHASES = (S.LOADOUT, S.UNIT_UPGRADE, S.BOX_OPENED, S.BASE_UPGRADE, S.AD_IMPRESSION)


def _pick(index: str, names: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{name}'" for name in names)
    return f"get(array({listed}), cast({index} as int))"


NAME = f"""case event_type
    when 'signup' then if(event_id % 2 = 0, '{S.FIRST_OPEN}', '{S.LEVEL_START}')
    when 'click' then '{S.LEVEL_COMPLETE}'
    when 'error' then '{S.LEVEL_FAIL}'
    when 'view' then {_pick("event_id % 9", S.REWARDED_ADS)}
    when 'purchase' then {_pick("event_id % 5", PURCHASES)}
end"""
# From calendar fields: `timestampdiff` and `unix_micros` go through the session zone and shift
# values that fall in a daylight-saving gap.
MICROS = """(unix_date(cast(ts as date)) * 86400L + hour(ts) * 3600 + minute(ts) * 60) * 1000000L
    + cast(extract(second from ts) * 1000000 as bigint)"""
PLATFORM = "if(user_id % 2 = 0, 'IOS', 'ANDROID')"
VERSION = "concat('1.', user_id % 12, '.0')"
LEVEL = "if(k < 95, k % 20 + 1, null)"
SECONDS = "if(event_id % 7 <> 0, value, null)"
WHOLE_SECONDS = "if(event_id % 7 = 0, floor(value), null)"
UNITS = """concat(k % 5, ' - U', k % 5, ', ', user_id % 4, ' - V', user_id % 4, ',',
    if(k % 10 = 0, '', ' 9 - Drone'))"""
UNIT = "concat(k % 7, ' - Unit', k % 7)"
BOX = "concat('box_', k % 6)"
SKILL = _pick("k % 3", S.BASE_SKILLS)
FORMAT = _pick("k % 2", S.AD_FORMATS)


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    # No broadcast hint: Spark compares the file size of `nation` with its threshold. Events without
    # a user have no country.
    nation = spark.read.schema(NATION).parquet(f"{sf_dir}/nation.parquet")
    source = source.join(nation, source.user_id % 25 == nation.n_nationkey, "left")
    # `props` is {"k": n}: cutting the text is far cheaper than parsing it as JSON for each use.
    return source.selectExpr(
        "*", "cast(split_part(split_part(props, ':', 2), '}', 1) as bigint) as k"
    )


def sample_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat events."""
    return _numbered(spark, sf_dir).selectExpr(
        f"cast(user_id as string) as {S.USER}",
        f"{MICROS} as event_timestamp",
        f"{NAME} as event_name",
        f"{PLATFORM} as platform",
        "n_name as country",
        f"{VERSION} as version",
        f"{LEVEL} as level",
        f"coalesce({SECONDS}, cast({WHOLE_SECONDS} as double)) as duration_seconds",
        f"{SECONDS} as duration_seconds_dbl",
        f"{UNITS} as unit_names",
        f"{UNIT} as unit_name",
        f"{BOX} as box_id",
        f"{SKILL} as skill",
        f"{FORMAT} as ad_format",
        "event_id",
        "cast(ts as date) as event_date",
    )


def _param(key: str, text: str = "null", whole: str = "null", real: str = "null") -> str:
    return f"""named_struct('key', '{key}', 'value', named_struct(
        'string_value', cast({text} as string), 'int_value', cast({whole} as bigint),
        'float_value', cast(null as float), 'double_value', cast({real} as double)))"""


def raw_sample_events(spark: SparkSession, sf_dir: str, box_key: str = S.BOX_KEY) -> DataFrame:
    """Nested events: every parameter in the bag of every event."""
    params = ", ".join(
        [
            _param("level", whole=LEVEL),
            _param("duration_seconds", whole=WHOLE_SECONDS, real=SECONDS),
            _param("unit_names", text=UNITS),
            _param("unit_name", text=UNIT),
            _param(box_key, text=BOX),
            _param("Skill", text=SKILL),
            _param("ad_format", text=FORMAT),
        ]
    )
    return _numbered(spark, sf_dir).selectExpr(
        f"cast(user_id as string) as {S.USER}",
        f"{MICROS} as event_timestamp",
        f"{NAME} as event_name",
        f"{PLATFORM} as platform",
        "named_struct('country', n_name) as geo",
        f"named_struct('version', {VERSION}) as app_info",
        f"array({params}) as event_params",
        "event_id",
        "cast(ts as date) as event_date",
    )
