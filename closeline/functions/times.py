"""Calendar expressions: slate day, season, start windows, rest, minutes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from closeline.functions.prices import col, number

LOCAL_ZONE = "America/New_York"
IMMINENT_MINUTES = 60
REST_LABELS = (
    ("second game in two days", 1, 1),
    ("one day off", 2, 2),
    ("ordinary rest", 3, 5),
    ("six or more days off", 6, 10**6),
)
REST_REFERENCE = "ordinary rest"


def slate_date(start: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """Local calendar day of a start given in UTC."""
    return F.to_date(F.from_utc_timestamp(col(start).cast("timestamp"), zone))


def season_of(day: Column | str) -> Column:
    """Season named by the year it ends in; it rolls over in July."""
    d = col(day)
    return (F.year(d) + F.when(F.month(d) >= 7, 1).otherwise(0)).cast("long")


def tip_window(start: Column | str, zone: str = LOCAL_ZONE) -> Column:
    hour = F.hour(F.from_utc_timestamp(col(start).cast("timestamp"), zone))
    return F.when((hour >= 21) | (hour < 8), "late").when(hour >= 17, "early_evening").when(hour >= 8, "afternoon")


def tip_state(start: Column | str, now: Column, imminent_minutes: int = IMMINENT_MINUTES) -> Column:
    s = col(start).cast("timestamp")
    minutes = (F.unix_micros(s) - F.unix_micros(now.cast("timestamp"))) / 60e6
    return (
        F.when(s.isNull(), "unconfirmed")
        .when(minutes <= 0, "started")
        .when(minutes <= imminent_minutes, "imminent")
        .otherwise("upcoming")
    )


def can_be_played(state: Column | str) -> Column:
    return F.coalesce(col(state) == "upcoming", F.lit(False))


def rest_bucket(days: Column | str) -> Column:
    d = number(days)
    out = F.when(d.isNull() | (d < 1), None)
    for label, low, high in REST_LABELS:
        out = out.when(d.between(low, high), F.lit(label))
    return out


def parse_minutes(text: Column | str) -> Column:
    """'34' or '34:12' as minutes."""
    t = col(text).cast("string")
    parts = F.split(t, ":")
    whole = F.try_element_at(parts, F.lit(1)).try_cast("double")
    seconds = F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when(t.contains(":"), whole + seconds / 60.0).otherwise(t.try_cast("double"))


def minutes_bucket(minutes: Column | str, edges: tuple[float, ...]) -> Column:
    """Index of the bin (left edge included); -1 when unknown."""
    m = number(minutes)
    index = sum((F.when(m >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(m.isNull(), F.lit(-1)).otherwise(index).cast("long")
