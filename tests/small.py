"""Hand-made events."""

from datetime import datetime, timezone

from playtrail.sources.events import flatten_events
from playtrail.sources.schema import RAW_EVENT

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(text: str) -> int:
    """'2024-01-01' or '2024-01-01 10:00:00.5' in UTC."""
    span = datetime.fromisoformat(text).replace(tzinfo=timezone.utc) - EPOCH
    return (span.days * 86400 + span.seconds) * 1_000_000 + span.microseconds


def value(**fields):
    names = ("string_value", "int_value", "float_value", "double_value")
    return tuple(fields.get(name) for name in names)


def param(key, val):
    if isinstance(val, tuple):
        return key, val
    field = {str: "string_value", int: "int_value", float: "double_value"}[type(val)]
    return key, value(**{field: val})


def event(user, name, at, platform="IOS", country="FI", version="1.0", params=(), **named):
    bag = None if params is None else [param(k, v) for k, v in [*params, *named.items()]]
    moment = micros(at) if isinstance(at, str) else at
    return (user, moment, name, platform, (country,), (version,), bag)


def raw(spark, events):
    return spark.createDataFrame(events, RAW_EVENT)


def flat(spark, events):
    return flatten_events(raw(spark, events))


def rows(df):
    """Rows as a sorted list of dicts without order of columns."""
    return sorted(
        (r.asDict(recursive=True) for r in df.collect()),
        key=lambda d: [(v is None, str(v)) for _, v in sorted(d.items())],
    )


def table(df, *columns):
    """Chosen columns as a list of tuples, in result order."""
    return [tuple(r) for r in df.select(*columns).collect()]
