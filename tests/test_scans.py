"""Folds by blocks against plain loops over each track."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import scans
from wayfold.operators import tracks as k

ROW = "vehicle_id bigint, t_us bigint, fix_id bigint, speed double"


def loops(rows, alpha=0.05, q=5.0, r=4.0, p0=25.0):
    """Vehicle to (exponential mean, Kalman speed, variance, mean NIS, rows)."""
    by, out = {}, {}
    for v, t, i, z in rows:
        by.setdefault(v, []).append((t is not None, t or 0, i, z))
    for v, fixes in by.items():
        mean = x = None
        p, nis = p0, 0.0
        for *_, z in sorted(fixes):
            if mean is None:
                mean = x = z
                continue
            mean += alpha * (z - mean)
            prior = p + q
            nis += (z - x) ** 2 / (prior + r)
            x += prior / (prior + r) * (z - x)
            p = prior * r / (prior + r)
        out[v] = (mean, x, p, nis / (len(fixes) - 1) if len(fixes) > 1 else None, len(fixes))
    return out


def made(seed, vehicles=7):
    """Tracks of very different lengths, one of them with a third of the rows and more; ties in time."""
    rng = random.Random(seed)
    rows = []
    for v in range(vehicles):
        t = rng.randrange(10**10)
        for n in range(1500 if v == 0 else rng.choice([1, 2, 40, 300])):
            t += rng.choice([0, 1_000_000, 30_000_000, 5_000_000_000])
            rows.append((v, t, n, rng.random() * 80))
    rng.shuffle(rows)
    return rows


def same(got, want, places=9):
    assert got.keys() == want.keys()
    for v, row in got.items():
        assert row == pytest.approx(want[v], rel=10**-places, abs=10**-places), v


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_equal_loops(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, ROW).repartition(5)
    want = loops(rows)
    same({r["vehicle_id"]: (r["mean"], r["fixes"]) for r in k.exponential_mean(df, 0.05).collect()}, {v: (w[0], w[4]) for v, w in want.items()})
    same({r["vehicle_id"]: (r["speed"], r["variance"]) for r in k.kalman_speed(df).collect()}, {v: w[1:3] for v, w in want.items()})
    same({r["vehicle_id"]: (r["mean_nis"], r["n"]) for r in k.innovations(df).where("n > 0").collect()}, {v: (w[3], w[4] - 1) for v, w in want.items() if w[4] > 1})


@pytest.mark.parametrize(("slot", "fan"), [(1_000_000, 2), (60_000_000, 7), (10**15, 256)])
def test_blocks_do_not_matter(spark, slot, fan):
    rows = made(3, 3)
    df = spark.createDataFrame(rows, ROW)
    got = scans.fold(df, lambda n: F.lit(0.3), slot_us=slot, fan=fan)
    same({r["vehicle_id"]: (r["x"], r["n"]) for r in got.collect()}, {v: (w[0], w[4]) for v, w in loops(rows, 0.3).items()})


def test_odd_rows(spark):
    """No rows; null vehicles are one, null times come first, a null value makes the estimate null; clashing columns."""
    assert k.exponential_mean(spark.createDataFrame([], ROW), 0.05).isEmpty()
    rows = [(None, 5, 1, 10.0), (None, 7, 2, 20.0), (1, None, 1, 30.0), (1, 4, 2, 50.0), (2, 1, 1, 1.0), (2, 2, 2, None), (3, 1, 1, 7.0)]
    df = spark.createDataFrame(rows, ROW).selectExpr("*", "1 as n", "'x' as _key", "2 as m", "3 as before")
    got = {r["vehicle_id"]: (r["mean"], r["fixes"]) for r in k.exponential_mean(df, 0.05).collect()}
    assert got == {None: (10.5, 2), 1: (31.0, 2), 2: (None, 2), 3: (7.0, 1)}


def test_one_vehicle_goes_over_many_tasks(spark):
    """The rows of a vehicle are grouped by vehicle and slot; nothing but counts and maps is shuffled by vehicle alone."""
    df = spark.createDataFrame([(1, h * scans.HOUR_US + s, s, 1.0) for h in range(64) for s in range(3)], ROW)
    plan = k.exponential_mean(df, 0.05)._jdf.queryExecution().executedPlan().toString()
    collects = [line for line in plan.splitlines() if "collect_list(_row" in line]
    assert collects and all("_key" in line and "_slot" in line for line in collects)
