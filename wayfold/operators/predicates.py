"""Predicates on vehicles, routes, stops and trip options as columns, to be combined with & | ~.

Nulls: every predicate is true or false. A missing boolean counts as false, a missing position or time as stale.
Neutral elements are real truth values: OR with TRUE is TRUE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds of motion (km/h) and recency (s), the plate format, and the service area.
MOVING_KMH, RECENT_S, STALE_MIN = 1.0, 300, 10
PLATE = r"^\d{4}\s[A-Z]{3}$"
AREA = {"south": 35.0, "north": 43.0, "west": 52.0, "east": 67.0}


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_active() -> Column:
    return yes(F.col("is_active"))


def in_motion() -> Column:
    return yes(F.col("in_motion")) & yes(F.col("speed") > MOVING_KMH)


def is_stationary() -> Column:
    return ~yes(F.col("in_motion")) | yes(F.col("speed") <= MOVING_KMH) | F.col("speed").isNull()


def recent(now_us: int, seconds: int = RECENT_S) -> Column:
    return yes(F.col("updated_us") > now_us - seconds * 1_000_000)


def stale(now_us: int, minutes: int = STALE_MIN) -> Column:
    return F.col("updated_us").isNull() | yes(F.col("updated_us") < now_us - minutes * 60_000_000)


def is_assigned() -> Column:
    return F.col("route_id").isNotNull()


def has_position() -> Column:
    return F.col("lat").isNotNull() & F.col("lon").isNotNull()


def has_plate() -> Column:
    return yes(F.length(F.trim("plate")) > 0)


def ready_for_service(now_us: int) -> Column:
    return is_active() & is_assigned() & has_position() & recent(now_us)


def operational(now_us: int) -> Column:
    return is_active() & recent(now_us)


def requires_attention(now_us: int) -> Column:
    return is_active() & (stale(now_us, STALE_MIN) | ~is_assigned())


def actively_working(now_us: int) -> Column:
    return ready_for_service(now_us) & in_motion()


def contains_ignoring_case(c: str, part: str) -> Column:
    return yes(F.lower(c).contains(part.lower()))


def in_area(lat: Column, lon: Column) -> Column:
    return yes(lat.between(AREA["south"], AREA["north"]) & lon.between(AREA["west"], AREA["east"]))


def optional(name: str, value: object | None) -> Column:
    """name = value; TRUE if there is no value."""
    return F.lit(True) if value is None else yes(F.col(name) == F.lit(value))


def any_of(*parts: Column) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def all_of(*parts: Column) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out
