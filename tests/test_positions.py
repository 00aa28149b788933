"""The motion filter's seconds, losses and stop events; as a batch, as batches that hand their state on, and as a stream."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import motion
from wayfold.streaming import positions

K = motion.DEGREE_PLANE_M * math.cos(math.radians(37.95))
LENGTH, STOPS = 6000.0, 7
FIX = "vehicle_id bigint, t_us bigint, fix_id bigint, route_id bigint, lat double, lon double, speed double, hdop double"


def line_points(direction):
    points = [(37.95, 58.3 + LENGTH * i / (STOPS - 1) / K) for i in range(STOPS)]
    return points if direction == 0 else points[::-1]


@pytest.fixture(scope="module")
def placed(spark):
    rows = [(1, d, n + 1, lat, lon) for d in (0, 1) for n, (lat, lon) in enumerate(line_points(d))]
    return spark.createDataFrame(rows, "route_id bigint, direction int, seq int, lat double, lon double")


def track(vehicle, profile, start=0.0, every=5, seed=1, sigma=3.0):
    """Fixes of a vehicle; profile: (seconds, speed m/s, whether fixes come) one after another."""
    rng, x, t, out = random.Random(seed), start, 10, []
    for seconds, speed, seen in profile:
        for _ in range(int(seconds / every)):
            if seen:
                lat, lon = 37.95 + rng.gauss(0, sigma) / motion.DEGREE_PLANE_M, 58.3 + (x + rng.gauss(0, sigma)) / K
                out.append((vehicle, t * 1_000_000, vehicle * 100_000 + len(out), 1, lat, lon, speed * 3.6, 1.0))
            x, t = x + speed * every, t + every
    return out


def lines():
    return motion.to_lines({d: [{"lat": a, "lon": b} for a, b in line_points(d)] for d in (0, 1)})


def plain(fixes, until_us):
    """A clock that looks at the vehicle each second of silence, then the fix."""
    who, out = motion.Follower(lines()), []
    for vehicle, t, fix, _, lat, lon, kmh, hdop in sorted(fixes, key=lambda r: r[:3]):
        if t > until_us:
            break
        s = who.state
        if s.mode != "NEW":
            clock = s.t_us + 1_000_000
            while clock < t:
                out.extend((vehicle, *r) for r in who.seconds(clock))
                clock += 1_000_000
        if row := who.fix(fix, t, lat, lon, kmh, hdop):
            out.append((vehicle, *row))
    out.extend((fixes[0][0], *r) for r in who.seconds(until_us))
    return out


DRIVES = {
    # to a stop at 1000 m, standing there, on past the next one, then silence
    1: [(85, 10, True), (10, 5, True), (40, 0, True), (150, 10, True), (200, 10, False), (60, 10, True)],
    2: [(300, 9, True), (40, 9, False), (100, 9, True)],
    3: [(60, 12, True), (400, 12, False)],
    4: [(700, 10, True)],
}


def all_fixes():
    return [f for v, p in DRIVES.items() for f in track(v, p, start=100.0, seed=v)]


def rows_of(df):
    names = [c.split()[0] for c in motion.POSITION.split(", ")]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=lambda r: (r[0], r[1], r[2] is None))


def expected(until_us):
    return sorted((r for v in DRIVES for r in plain([f for f in all_fixes() if f[0] == v], until_us)), key=lambda r: (r[0], r[1], r[2] is None))


def test_seconds_equal_a_clock(spark, placed):
    until = 900_000_000
    fixes = spark.createDataFrame(all_fixes(), FIX)
    got = motion.follow(fixes, placed, True, until)
    assert rows_of(got.where("state is null")) == expected(until)


def test_losses_come_by_timeout():
    rows = plain(track(3, DRIVES[3], start=100.0, seed=3), 900_000_000)
    last = max(t for _, t, fix, *_ in rows if fix is not None)
    said = {e: (t - last) / 1e6 for _, t, fix, _, e, *_ in rows if fix is None and e}
    assert said == {"GPS_LOST": 16.0, "NO_GPS": 91.0}
    silent = [r for r in rows if r[1] > last]
    assert [r[1] - last for r in silent] == [k * 1_000_000 for k in range(1, 92)]
    assert silent[0][7] > 0 and silent[-1][8] == 0 and silent[-1][7] == silent[-2][7]
    steps = [b[7] - a[7] for a, b in zip(silent, silent[1:-1])]
    assert all(abs(d - silent[0][8]) < 1e-6 for d in steps)


def test_estimates_of_fixes_are_the_same_without_seconds():
    for v, p in DRIVES.items():
        fixes = track(v, p, start=100.0, seed=v)
        who = motion.Follower(lines())
        alone = [(v, *who.fix(f[2], f[1], *f[4:])) for f in fixes]
        with_seconds = [r for r in plain(fixes, 900_000_000) if r[2] is not None]
        assert [(*r[:4], *r[5:]) for r in alone] == [(*r[:4], *r[5:]) for r in with_seconds]


def test_stop_events():
    events = [e for *_, e in [(r[1], r[4]) for r in plain(track(1, DRIVES[1], start=100.0, seed=1, sigma=1.0), 900_000_000)] if e]
    flat = [x for e in events for x in e.split(",")]
    assert flat[:5] == ["ACQUIRED", "DECEL_ENTER", "DWELL_ENTER", "DWELL_EXIT", "DECEL_ENTER"]
    assert "SKIP" in flat and flat.count("DWELL_ENTER") == 1 and "GPS_LOST" in flat and "NO_GPS" in flat
    long = track(5, [(90, 10, True), (700, 0, True)], start=100.0, sigma=1.0)
    flat = [x for r in plain(long, 900_000_000) for x in r[4].split(",") if x]
    assert flat.count("DWELL_OUTLIER") == 1 and "DWELL_EXIT" not in flat
    end = track(6, [(700, 10, True)], start=100.0, sigma=1.0)
    flat = [x for r in plain(end, 900_000_000) for x in r[4].split(",") if x]
    assert flat.count("AT_TERMINAL") == 1 and flat.count("SKIP") >= 4


def test_batches_hand_their_state_on(spark, placed):
    until = 900_000_000
    fixes = spark.createDataFrame(all_fixes(), FIX)
    cut = 237_000_000
    a = motion.follow(fixes.where(f"t_us <= {cut}"), placed, True, cut).cache()
    b = motion.follow(fixes.where(f"t_us > {cut}"), placed, True, until, a.where("state is not null").select("vehicle_id", "route_id", "state"))
    assert rows_of(a.where("state is null").unionByName(b.where("state is null"))) == expected(until)


def test_empty_and_odd_fixes(spark, placed):
    assert motion.follow(spark.createDataFrame([], FIX), placed, True, 10).isEmpty()
    twice = track(1, [(60, 10, True)])
    odd = [*twice, *twice, (2, 10_000_000, 1, 99, 37.95, 58.3, 5.0, None), (None, 10_000_000, 2, 1, 37.95, 58.3, 5.0, None), (3, 10_000_000, 3, 1, 37.95, 58.3, 5.0, None)]
    got = motion.follow(spark.createDataFrame(odd, FIX), placed).where("state is null")
    assert sorted((r["vehicle_id"] or 0, r["n"]) for r in got.groupBy("vehicle_id").agg(F.count("*").alias("n")).collect())[-2:] == [(1, 12), (3, 1)]


@pytest.mark.parametrize("restart", [False, True])
def test_stream_equals_batch(spark, placed, tmp_path, restart):
    """Micro-batches in shuffled order within the lateness, each vehicle's rows over several, and a restart in between."""
    rng = random.Random(7)
    clock = [(99, 1_100_000_000, 1, 98, 0.0, 0.0, 0.0, 1.0)]  # a vehicle without a line, whose fix moves the watermark
    rows = sorted(all_fixes(), key=lambda f: f[1] + rng.random() * 50e6)
    parts = [rows[k : k + len(rows) // 5 + 1] for k in range(0, len(rows), len(rows) // 5 + 1)] + [clock]
    schema = spark.createDataFrame([], FIX).schema
    vehicles = motion.vehicle_lines(spark.createDataFrame(all_fixes(), FIX), placed)

    def write(part, n):
        spark.createDataFrame(part, FIX).coalesce(1).write.parquet(f"{tmp_path}/staged/{n}")
        import glob
        import os
        import shutil

        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        shutil.copy(glob.glob(f"{tmp_path}/staged/{n}/*.parquet")[0], f"{tmp_path}/in/{n}.parquet")
        os.utime(f"{tmp_path}/in/{n}.parquet", (1_000_000 + n, 1_000_000 + n))

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_micros("t_us"))
        live = positions.live_positions(stream, vehicles, "100 seconds")
        live.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    for n, part in enumerate(parts):
        write(part, n)
        if restart and n == 2:
            go()
    go()
    until = 1_000_000_000
    assert rows_of(spark.read.schema(motion.POSITION).parquet(f"{tmp_path}/out")) == expected(until)
