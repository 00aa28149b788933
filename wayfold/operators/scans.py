"""Folds over long tracks by an associative scan: blocks of rows are folded apart, their maps composed in order.

An exponential mean and a scalar Kalman filter both move an estimate x to (1 - g) x + g z at a row of value z, where the
gain g depends on the row's number only: it is constant, or comes from the filter's variance, a Moebius map of itself
whose n-th power has a closed form. So a block of rows is an affine map of x, and the sum of its squared innovations
over their variances a quadratic in x; such a pair, once composed with the next one, is such a pair again.

A block is a key's rows of one slot of time, so one key goes over many tasks, and only its rows' counts and its blocks'
maps, a few numbers each, meet: maps by `fan` slots first, then what is left of a key. The only lists are those.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A map: x to a x + b at the cost c0 + c1 x + c2 x^2.
MAP = ("a", "b", "c0", "c1", "c2")
HOUR_US = 3_600_000_000


def _map(**numbers: Column) -> Column:
    # the cast lets the numbers be null
    return F.struct(*[numbers[n].alias(n) for n in MAP]).cast("struct<" + ", ".join(f"{n}: double" for n in MAP) + ">")


def _identity() -> Column:
    return _map(a=F.lit(1.0), b=F.lit(0.0), c0=F.lit(0.0), c1=F.lit(0.0), c2=F.lit(0.0))


def then(f: Column, g: Column) -> Column:
    """The map f, and after it g."""
    return _map(
        a=g["a"] * f["a"], b=g["a"] * f["b"] + g["b"],
        c0=f["c0"] + g["c0"] + g["c1"] * f["b"] + g["c2"] * f["b"] * f["b"], c1=f["c1"] + g["c1"] * f["a"] + 2 * g["c2"] * f["a"] * f["b"], c2=f["c2"] + g["c2"] * f["a"] * f["a"],
    )


def kalman_variance(n: Column, q: float, r: float, p0: float) -> Column:
    """The variance after row n (from 0) of a filter with process noise q and measurement noise r: p to r (p + q) / (p + q + r), n times."""
    root = math.sqrt(q * q + 4 * r * q)
    f1, f2 = (-q + root) / 2, (-q - root) / 2
    w = F.pow(F.lit((r - f1) / (r - f2)), n) * ((p0 - f1) / (p0 - f2))
    return (f1 - f2 * w) / (1 - w)


def _row(z: Column, n: Column, gain: Callable[[Column], Column], spread: Callable[[Column], Column]) -> Column:
    """The map of row n: the first one sets the estimate, later ones correct it at the cost of their innovation."""
    first, g, s = n == 0, gain(n), spread(n)
    later = lambda c: F.when(first, 0.0).otherwise(c)
    return _map(a=later(1 - g), b=F.when(first, z).otherwise(g * z), c0=later(z * z / s), c1=later(-2 * z / s), c2=later(1 / s))


def fold(rows: DataFrame, gain: Callable[[Column], Column], spread: Callable[[Column], Column] | None = None, value: str = "speed", key: str = "vehicle_id", time: str = "t_us", tie: str = "fix_id", slot_us: int = HOUR_US, fan: int = 256) -> DataFrame:
    """By key: (key, x, cost, n), the estimate after its last row in order of time and tie, the sum of squared innovations over
    spread, and the rows there are.

    gain, spread: of a row's number, from 0; the first row has neither. A null value makes the estimate null; null keys are a
    key, null times come first. One slot's rows of a key lie in one task: slot_us bounds them by the rate of fixes.
    """
    r = rows.select(F.col(key).alias("_key"), F.expr(f"{time} div {int(slot_us)}").alias("_slot"), F.struct(F.col(time).alias("t"), F.col(tie).alias("i"), F.col(value).cast("double").alias("z")).alias("_row"))
    counts = r.groupBy("_key", "_slot").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("_key").orderBy(F.col("_slot").asc_nulls_first())
    before = counts.select(F.col("_key").alias("k"), F.col("_slot").alias("s"), "n", F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), (F.floor((F.row_number().over(w) - 1) / fan)).alias("group"))
    held = r.groupBy("_key", "_slot").agg(F.array_sort(F.collect_list("_row")).alias("v"))
    met = held.join(before, F.col("_key").eqNullSafe(F.col("k")) & F.col("_slot").eqNullSafe(F.col("s")))
    spread = spread or (lambda n: F.lit(1.0))
    numbered = F.transform("v", lambda x, i: F.struct(x["z"].alias("z"), (F.col("before") + i).alias("n")))
    maps = met.select("_key", "_slot", "group", "n", F.aggregate(numbered, _identity(), lambda acc, x: then(acc, _row(x["z"], x["n"], gain, spread))).alias("m"))
    for by, order in ((["_key", "group"], "_slot"), (["_key"], "group")):
        parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).isNotNull().alias("late"), F.col(order).alias("o"), "m"))), lambda p: p["m"])
        maps = maps.groupBy(*by).agg(F.sum("n").alias("n"), parts.alias("p")).select(*by, "n", F.aggregate("p", _identity(), then).alias("m"))
    # the first row forgets what was before it, so any start gives the same
    return maps.select(F.col("_key").alias(key), F.col("m.b").alias("x"), F.col("m.c0").alias("cost"), "n")
