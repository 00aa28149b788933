"""Functions of time: local hours, shifts, periods of the day, ages. Times are microseconds since 1970 in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The service's zone is UTC+5 all year.
ZONE_S = 5 * 3600
#: First hour, multiplier of waiting, wait in minutes and speed in km/h of each period of the day; the
#: night goes on after midnight.
PERIODS = (("NIGHT", 0, 0.9, 25, 30.0), ("MORNING_RUSH", 7, 1.2, 6, 12.0), ("DAYTIME", 10, 1.1, 12, 18.0), ("EVENING_RUSH", 17, 1.4, 8, 12.0), ("EVENING", 20, 1.1, 15, 25.0), ("NIGHT", 23, 0.9, 25, 30.0))


def local_seconds(us: Column) -> Column:
    return F.floor(us / 1_000_000) + ZONE_S


def local_hour(us: Column) -> Column:
    return (F.floor(local_seconds(us) / 3600) % 24).cast("int")


def is_weekend(us: Column) -> Column:
    """Saturday or Sunday; 1970-01-01 was a Thursday."""
    return (F.floor(local_seconds(us) / 86400) + 3) % 7 >= 5


def shift(us: Column) -> Column:
    """FIRST from 5 to 14, SECOND else."""
    h = local_hour(us)
    return F.when((h >= 5) & (h < 14), "FIRST").otherwise("SECOND")


def shift_covers(name: Column, us: Column) -> Column:
    """Whether a shift has an instant: FIRST 5-14, SECOND 14-23, FULL_DAY 5-23."""
    h = local_hour(us)
    return F.when(name == "FIRST", h.between(5, 13)).when(name == "SECOND", h.between(14, 22)).when(name == "FULL_DAY", h.between(5, 22)).otherwise(False)


def _period(hour: Column, field: int) -> Column:
    out = F.lit(PERIODS[0][field])
    for p in PERIODS[1:]:
        out = F.when(hour >= p[1], F.lit(p[field])).otherwise(out)
    return out


def period(us: Column) -> Column:
    return _period(local_hour(us), 0)


def expected_wait(us: Column) -> Column:
    """Minutes of waiting by period, five more at weekends, 30 at most."""
    base = _period(local_hour(us), 3) + F.when(is_weekend(us), 5).otherwise(0)
    return F.least(base, F.lit(30))


def expected_speed(us: Column) -> Column:
    return _period(local_hour(us), 4)


def multiplier(us: Column) -> Column:
    return _period(local_hour(us), 2) * F.when(is_weekend(us), 0.8).otherwise(1.0)


def freshness(age_s: Column, on_route: Column) -> Column:
    return F.when((age_s <= 3) & on_route, "HIGH").when(age_s <= 10, "MEDIUM").when(age_s <= 30, "LOW").otherwise("STALE")


def tariff_days(period_name: Column) -> Column:
    """Days of a tariff period, fixed rather than by the calendar."""
    days = {"DAY": 1, "WEEK": 7, "MONTH": 30, "QUARTER": 90, "YEAR": 365}
    out = F.lit(None).cast("int")
    for name, n in days.items():
        out = F.when(period_name == name, n).otherwise(out)
    return out
