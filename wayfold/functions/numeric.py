"""Arithmetic of motion and of trip options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def time_to_stop(dist: Column, v_now: Column, v_cruise: Column, a: float) -> Column:
    """Seconds to a stop at `dist` metres: speed up to cruise, cruise, brake at a; a triangle if there is no room."""
    up = (v_cruise * v_cruise - v_now * v_now) / (2 * a)
    down = v_cruise * v_cruise / (2 * a)
    peak = F.sqrt(F.greatest(F.lit(0.0), (2 * a * dist + v_now * v_now) / 2))
    full = (v_cruise - v_now) / a + (dist - up - down) / v_cruise + v_cruise / a
    return F.when(dist <= 0, 0.0).when(dist >= up + down, full).otherwise((peak - v_now) / a + peak / a)


def damped(factor: Column, ahead: Column) -> Column:
    """A live factor that fades over five stops."""
    return F.when(ahead < 5, 1 + (factor - 1) * (5 - ahead) / 5).otherwise(1.0)


def confidence(variance: Column) -> Column:
    return 1 / (1 + variance / 2500.0)


def turn_window(base: float, v: Column, tau: Column, tau0: float, cap: float) -> Column:
    return F.least(base + v * F.greatest(F.lit(0.0), tau - tau0), F.lit(cap))


def loop_delta(delta: Column, length: Column) -> Column:
    """A difference of positions on a loop, in (-length/2, length/2]."""
    d = F.pmod(delta, length)
    return F.when(d > length / 2, d - length).otherwise(d)


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, two decimals half up; null if whole is 0."""
    return F.when(whole != 0, F.round((part * 100 / whole).cast("decimal(20,10)"), 2).cast("double"))
